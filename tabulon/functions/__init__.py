"""Column functions: types, names, dates, numbers and HTML."""
