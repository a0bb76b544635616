"""Readers: text with byte offsets, journal exports, retry directories, cluster snapshots, tailing."""
