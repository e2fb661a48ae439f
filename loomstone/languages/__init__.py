"""Query languages. All of them compile to one HybridQuery."""
