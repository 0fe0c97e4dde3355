"""Column-to-column building blocks; all of them stay in the JVM."""
