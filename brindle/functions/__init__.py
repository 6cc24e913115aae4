"""Column expressions: item codes, arrays, texts, scores, vectors, policy mathematics."""
