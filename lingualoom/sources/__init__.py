"""Readers and writers of the pipeline's file formats."""
