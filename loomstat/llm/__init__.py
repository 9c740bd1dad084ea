"""Operators that prepare transcripts, verdicts and documents as training data."""
