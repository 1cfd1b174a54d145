"""Operators of a training-data pipeline; nothing else in the package imports them."""

from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)
