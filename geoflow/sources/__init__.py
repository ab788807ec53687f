"""Readers and writers of tables and features."""
