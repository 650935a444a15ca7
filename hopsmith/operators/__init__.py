"""Operators over QA records, logs and steps."""
