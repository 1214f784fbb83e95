"""Column functions: geography, text, scores."""
