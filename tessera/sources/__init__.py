"""Readers for the tables and file formats the engine consumes."""
