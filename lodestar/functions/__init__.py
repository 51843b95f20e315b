"""Column expressions; all run inside Spark's own code generation unless they say otherwise."""
