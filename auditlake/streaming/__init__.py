"""Structured Streaming forms of the detectors and usage metrics."""
