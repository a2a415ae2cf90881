"""Column functions: text, numbers, tolerant JSON and evidence lists."""
