"""Column functions: plain ``Column -> Column`` helpers, all evaluated in the JVM."""
