"""Column-level building blocks: text, vectors, pair scores and citations."""
