"""Column functions: metrics between vectors, scalar helpers of the benchmark log."""
