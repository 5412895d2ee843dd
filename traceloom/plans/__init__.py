"""Queries made of the operators, and their registration."""
