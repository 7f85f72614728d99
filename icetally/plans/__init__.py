"""Whole jobs, and the queries that run the operators on the supplied test tables."""
