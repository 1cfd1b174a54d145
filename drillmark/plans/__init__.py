"""Queries of the engine, and their binding to the driver's tables."""
