"""Column functions: no Python runs per row here, everything stays in generated JVM code."""
