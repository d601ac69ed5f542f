"""Readers of the tables, the panel derived from them, and sinks."""
