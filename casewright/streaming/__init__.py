"""Streams: the batch operators over arriving files."""
