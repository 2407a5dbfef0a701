"""Column functions: they stay inside the JVM and inside Catalyst's view."""
