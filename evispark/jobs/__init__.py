"""Whole jobs from operators."""
