"""Relational and text operators as DataFrame compositions."""
