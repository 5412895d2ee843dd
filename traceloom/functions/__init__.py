"""Column functions over text, paths and dates."""
