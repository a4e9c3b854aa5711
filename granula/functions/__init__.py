"""Column expressions: vector algebra, boxes, solids, random numbers, statistics."""
