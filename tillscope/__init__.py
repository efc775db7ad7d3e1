"""Marketing analytics over order lines, written as Spark DataFrame operators."""
