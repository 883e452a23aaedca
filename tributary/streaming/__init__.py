"""Structured Streaming: following files, hubs, windowed counts."""
