"""Queries over whole tables, composed of the operators."""
