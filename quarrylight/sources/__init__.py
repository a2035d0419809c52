"""Readers, admission of files, text parsers, sinks."""
