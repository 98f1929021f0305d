"""Readers (S01-S03, S10-S17, S22-S26)."""
