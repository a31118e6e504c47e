"""Runnable jobs: ``python -m jobs.<name> --help``. Each does its work in a function that takes a session."""
