"""Readers of landed bars and dimensions."""
