"""Batch jobs (DataFrame -> DataFrame), grouped by domain."""
