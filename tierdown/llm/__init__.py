"""Operators for training-data pipelines: extraction, archives, scans, deduplication,
tokenisation and quality. Nothing outside this subpackage imports it."""
