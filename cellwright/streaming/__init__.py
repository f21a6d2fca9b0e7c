"""Structured Streaming jobs over arriving granule files and ground samples."""
