"""Whole analyses, from log lines or directories to error reports."""
