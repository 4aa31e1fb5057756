"""Registered queries by topic; ``load()`` imports them all once."""

import importlib

TOPICS = ["audit", "signal", "design", "voting", "scoring", "statistics", "learning", "live"]


def load():
    for topic in TOPICS:
        importlib.import_module(f"seriesloom.catalog.{topic}")
    return importlib.import_module("seriesloom.catalog.registry")
