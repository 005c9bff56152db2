"""Column functions: text, URLs, time, scores."""
