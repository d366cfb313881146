"""The three workloads, and the queries that the driver runs with their oracle SQL."""
