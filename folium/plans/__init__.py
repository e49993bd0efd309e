"""Registered queries: an operator bound to the test tables, and its SQL."""

from folium.plans import anchors, corpus, knowledge, more, reading, retrieval, reusing, star, store
from folium.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "anchors", "corpus", "knowledge", "more", "reading", "retrieval", "reusing", "star", "store"]
