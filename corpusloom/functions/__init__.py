"""Column expressions and Arrow functions over text, URLs and HTML."""
