"""Query plans that combine several operators."""
