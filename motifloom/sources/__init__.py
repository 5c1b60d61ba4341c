"""Readers and writers of sequence, motif, alignment and result formats."""
