"""Input bindings, skew-safe scans and the job registry."""
