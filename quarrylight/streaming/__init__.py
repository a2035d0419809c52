"""Streams: de-duplication, windows, sessions, keyed state, idempotent sinks."""
