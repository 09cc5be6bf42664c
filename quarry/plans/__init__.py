"""Queries over the synthetic tables, and whole analyses of source trees."""
