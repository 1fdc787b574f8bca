"""Readers and writers: streams, the day-partitioned lake, relational tables, wire formats."""
