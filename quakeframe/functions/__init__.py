"""Column functions: geometry, times, weights and robust statistics."""
