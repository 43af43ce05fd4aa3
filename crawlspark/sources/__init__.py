"""Readers and writers: messages, config documents, dedup index, WARC files."""
