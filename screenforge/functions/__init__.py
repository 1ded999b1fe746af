"""Column expressions. Everything here stays inside the JVM; nothing is a Python UDF."""
