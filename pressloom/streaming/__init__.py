"""Incremental runs: resume, batched commits, error rows, run statistics."""
