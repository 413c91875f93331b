"""Vespera engine package."""
