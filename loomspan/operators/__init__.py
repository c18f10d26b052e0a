"""Operators of span-annotated text."""
