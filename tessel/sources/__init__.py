"""Readers and writers of the text formats of sequences, annotations, expression and graphs, over Spark's own sources."""
