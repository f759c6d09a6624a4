"""Readers and writers of documents, graphs, run artifacts and benchmark corpora."""
