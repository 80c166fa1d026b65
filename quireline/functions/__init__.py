"""Column functions: text, entities, dates, arrays of words."""
