"""Schemas, readers and the partitioned writer."""
