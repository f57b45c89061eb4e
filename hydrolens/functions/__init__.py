"""Column-expression functions (all JVM-side, no Python UDFs)."""
