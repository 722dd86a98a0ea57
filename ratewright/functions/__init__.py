"""Statistics: intervals, tests and power, as expressions or as plain functions over a few numbers."""
