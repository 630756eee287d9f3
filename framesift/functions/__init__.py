"""Column functions: sampling, vectors, text and paths. All stay in the JVM."""
