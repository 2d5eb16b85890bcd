"""Stand-in tables over the given data, and the registered queries with their checks."""
