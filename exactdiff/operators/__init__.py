"""The operators: the difference of two sides, its summaries, snapshots of accepted differences, pages, suggestions."""
