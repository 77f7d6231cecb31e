"""Composed jobs, the star-schema views they run on, and their SQL twins."""
