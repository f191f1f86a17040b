"""Structural diff, patch, revert and history of nested documents."""
