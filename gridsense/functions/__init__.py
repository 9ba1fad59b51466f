"""Column-level building blocks: names, literals, coercions, time grains."""
