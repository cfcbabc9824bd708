"""Column functions: text, numbers, dates, geometry; numpy algorithms."""
