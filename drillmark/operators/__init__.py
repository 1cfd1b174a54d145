"""Reusable DataFrame operators, safe when one key holds much of the data."""
