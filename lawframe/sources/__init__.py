"""Readers of listings, saved pages and archives into tables."""
