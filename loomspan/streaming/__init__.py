"""Streaming of span-annotated text."""
