"""Incremental import of JSON-lines drops."""
