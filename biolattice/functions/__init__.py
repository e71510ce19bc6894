"""Column functions: keys and digests, sequences, gene rules, tagged text, casts."""
