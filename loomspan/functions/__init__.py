"""Functions of span-annotated text."""
