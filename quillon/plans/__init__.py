"""Plans: reading those that Catalyst makes, and the queries that cover the operators."""
