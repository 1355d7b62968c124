"""Incremental import."""
