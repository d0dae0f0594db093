"""Column-to-Column building blocks; every function stays on the JVM."""
