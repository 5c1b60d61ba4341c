"""The search over streams of sequences."""
