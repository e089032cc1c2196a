"""The same transformations on streams of files."""
