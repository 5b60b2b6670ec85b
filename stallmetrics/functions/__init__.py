"""Column functions: text, time, statistics, scoring."""
