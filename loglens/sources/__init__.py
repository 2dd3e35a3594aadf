"""Readers of raw logs and exports, and sinks."""
