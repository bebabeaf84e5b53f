"""The pair model: its tables, its use on pairs of sequences, and its training."""
