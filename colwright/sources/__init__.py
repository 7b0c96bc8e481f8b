"""Readers and writers: data tables, column metadata, run logs and reviews."""
