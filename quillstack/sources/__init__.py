"""Readers and writers of the file formats of the pipeline."""
