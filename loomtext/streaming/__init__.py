"""Structured Streaming: resumable and incremental runs."""
