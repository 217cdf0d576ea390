"""Column expressions and the few Arrow UDFs that Spark has no built-in for."""
