"""Column-to-column functions; all stay in the JVM."""
