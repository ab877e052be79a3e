"""Readers, writers and the company tables derived from the given star schema."""
