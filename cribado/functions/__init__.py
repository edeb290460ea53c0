"""Column expressions: no UDFs, all evaluated inside the JVM."""
