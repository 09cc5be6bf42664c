"""Readers of source trees, version control and events, and the extraction of facts from source texts."""
