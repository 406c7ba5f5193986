"""Whole conversions, and what they infer."""
