"""Queries over whole tables, composed of the library's operators."""
