"""The operators as queries over the shared tables, each next to the SQL that must agree with it."""
