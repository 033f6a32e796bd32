"""Operators on frames, scores and segments."""
