"""Analyses composed from the operators."""
