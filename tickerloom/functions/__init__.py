"""Column functions; all run JVM-side."""
