"""Operators on graphs, stores, curation logs and evidence."""
