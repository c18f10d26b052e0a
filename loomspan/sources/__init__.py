"""Sources of span-annotated text."""
