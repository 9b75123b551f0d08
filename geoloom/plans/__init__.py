"""Plans: the registered queries, the tables they derive, and the scenario pipeline."""
