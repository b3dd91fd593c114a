"""DataFrame operators on structures, constraints, graphs, samples and results."""
