"""Scalar helpers returning Columns, and build-time parsers."""
