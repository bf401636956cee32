"""Structured Streaming: watermarks, stateful processors, query runners."""
