"""Column functions over Japanese and structured text."""
