"""Column functions: text, identity, scoring. All of them stay inside the JVM."""
