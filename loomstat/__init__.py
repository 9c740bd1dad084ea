"""loomstat: analytics over long multi-message transcripts and their scores, on PySpark."""

__version__ = "0.1.0"
