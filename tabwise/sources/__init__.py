"""Readers and writers: tables, report tables, chart JSON, the run log."""
