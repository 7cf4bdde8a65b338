"""Column functions: text, numbers, matching, tables, coercion."""
