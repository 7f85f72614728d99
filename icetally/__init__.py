"""Hockey feed, play-by-play and match-up analytics as plain Spark DataFrame functions."""
