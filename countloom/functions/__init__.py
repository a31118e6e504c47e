"""Column functions with exact integer semantics."""
