"""The campaign view over the test tables, and the queries registered on it."""
