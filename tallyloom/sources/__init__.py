"""Readers of transcripts."""
