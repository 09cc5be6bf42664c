"""Operators for preparing training data for language models; nothing outside this subpackage imports it."""
