"""Readers and sinks: files in, writes, skip-if-exists, resumable chunks, processed-key logs."""
