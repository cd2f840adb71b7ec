"""Column-level building blocks: cleaning, rules, scores."""
