"""Column functions: normalization of codes, texts, quantities and dimensions, and rules over them."""
