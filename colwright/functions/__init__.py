"""Column functions: numbers, text, dates and program text."""
