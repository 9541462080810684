"""Blob listings, file extractors, batch files and sinks."""
