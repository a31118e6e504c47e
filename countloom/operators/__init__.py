"""Relational operators over count matrices and cohorts."""
