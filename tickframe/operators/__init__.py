"""Cleaning, validation and table-mutation operators."""
