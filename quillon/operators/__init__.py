"""DataFrame operators: joins, aggregation, ordering and scalar subqueries."""
