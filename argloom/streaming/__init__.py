"""Incremental processing of event streams, each with a batch twin."""
