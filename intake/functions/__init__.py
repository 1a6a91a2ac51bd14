"""Column functions: Column in, Column out, all evaluated by Spark."""
