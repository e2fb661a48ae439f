"""loomstone: a PySpark engine for versioned records with text, vectors, edges and validity intervals."""
