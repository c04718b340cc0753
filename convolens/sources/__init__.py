"""Readers and writers of transcripts, question-answer pairs and results."""
