"""Composite transforms from source records to graphs."""
