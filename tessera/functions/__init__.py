"""Column-level functions (JVM-side expressions)."""
