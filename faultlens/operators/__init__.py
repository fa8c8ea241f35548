"""Operators on tables of log lines and error lines."""
