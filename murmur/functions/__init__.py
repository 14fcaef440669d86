"""Column expressions (JVM-side, codegen friendly).  No Python UDFs here."""
