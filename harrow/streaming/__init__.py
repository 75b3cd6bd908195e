"""Incremental evaluation."""
