"""Column functions: text cleaning, guards, ids and vectors."""
