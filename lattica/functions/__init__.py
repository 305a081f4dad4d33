"""Column expressions: vectors, names and places. All run inside the JVM but normalise_names."""
