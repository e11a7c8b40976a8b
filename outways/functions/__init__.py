"""Column functions: geometry, clock times, names and kinds of places."""
