"""Column expressions. Every function takes and returns a Spark Column."""
