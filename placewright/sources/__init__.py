"""Readers and writers of the feeds, and the geography derived from the driver tables."""
