"""Readers and writers: tables, Markdown directories, converters and caches."""
