"""Queries over the derived panel, each with the SQL it is held against."""
PLANS = ("windows", "joins", "scores", "relational", "composites", "services", "provisions", "models", "ingest", "upkeep", "comparisons", "universes", "picks", "validation")
