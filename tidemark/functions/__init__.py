"""Column expressions. Python runs only where Spark has no built-in (NFKC, entities)."""
