"""All queries and their checking SQL."""

from __future__ import annotations

from . import feed_queries, match_queries, play_queries

REGISTERED = play_queries.QUERIES | match_queries.QUERIES | feed_queries.QUERIES
