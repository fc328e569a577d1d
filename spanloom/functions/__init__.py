"""Column expressions. Everything here stays inside the JVM unless a docstring says otherwise."""
