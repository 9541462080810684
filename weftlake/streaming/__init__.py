"""Structured Streaming jobs and their stateful operators."""
