"""Event-driven analyses."""
