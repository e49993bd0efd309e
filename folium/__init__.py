"""Folium: a PySpark-native engine for citation-grounded analytics over text corpora."""
