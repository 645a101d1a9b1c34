"""Scans, decoders and sinks (inventory A1-A7)."""
