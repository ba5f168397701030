"""Whole batch jobs made of operators."""
