"""Profiling, role inference, quality rules, transforms, log and document jobs."""
