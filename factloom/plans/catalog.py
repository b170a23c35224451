"""Imports the modules that register queries."""

from . import arithmetic, checks, classes, consistency, labels, learning, registry, reviews, rollups, timelines  # noqa: F401
