"""Column to Column: everything stays in JVM expressions."""
