"""Column functions: scalar words, and words on array columns."""
