"""Readers, writers and the partitioned report store."""
