"""Readers for bundles, sample streams, source text and report tables."""
