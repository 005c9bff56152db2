"""Readers of feeds, listings and pages, and table snapshots."""
