"""Lodestone: a PySpark-native engine for searching and organising a media catalogue at scale."""
