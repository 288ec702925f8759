"""Structured Streaming forms of operators that need no later samples."""
