"""Column functions on words, punctuation, case and vectors."""
