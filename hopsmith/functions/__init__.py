"""Column functions: text, metrics, vectors, uncertainty and prompts."""
