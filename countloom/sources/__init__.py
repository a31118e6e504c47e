"""Readers and writers: matrices, tables, frames and archives."""
