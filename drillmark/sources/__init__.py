"""Readers, record normalisers and idempotent sinks."""
