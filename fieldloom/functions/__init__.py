"""Column functions and their per-value counterparts."""
