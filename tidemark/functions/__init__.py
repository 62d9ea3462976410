"""Column builders: no joins, no shuffles, everything stays in the JVM."""
