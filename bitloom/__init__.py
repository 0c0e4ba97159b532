"""bitloom: Spark-first analytics for binary descriptors, robust estimation and frame streams."""
