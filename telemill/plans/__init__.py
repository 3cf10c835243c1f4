"""Query plans: the registry of named queries, their SQL oracles, the analyze run."""
