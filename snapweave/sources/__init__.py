"""Readers and writers for snapshots, workbooks, predictions, answer cache and log."""
