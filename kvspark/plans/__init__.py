"""Logical plans: the queries that show every operator, and their SQL twins."""
