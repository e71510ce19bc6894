"""Readers of sequence, annotation, model and protein-database files."""
