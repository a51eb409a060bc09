"""Column expressions. Everything stays JVM-side except the functions marked ``exact``."""
