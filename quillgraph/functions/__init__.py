"""Column functions: text, dates, scores, identifiers, structures."""
