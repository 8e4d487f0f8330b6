"""Reusable DataFrame operators: joins, ranking, shredding, filtering, merging, quality."""
