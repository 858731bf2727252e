"""Column functions: sets, names, edits."""
