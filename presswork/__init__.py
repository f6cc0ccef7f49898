"""Content-operations analytics as DataFrame-to-DataFrame operators."""
