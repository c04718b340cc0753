"""Column -> Column building blocks. Everything here is row-local and stays in the JVM,
except the two Arrow functions in ``fuzzy`` and ``literals``."""
