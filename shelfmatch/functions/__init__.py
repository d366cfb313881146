"""Column expressions: cleaning, keys, ISBNs and similarity. All are built-in functions, so they stay in the JVM."""
