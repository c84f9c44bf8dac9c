"""Column builders: expressions that stay inside the JVM."""
