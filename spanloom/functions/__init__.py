"""Column expressions: text, arrays, grading and parsing."""
