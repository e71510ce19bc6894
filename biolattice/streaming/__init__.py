"""Streaming forms of the curation roll-up and the graph load."""
