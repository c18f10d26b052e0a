"""Plans of span-annotated text."""
