"""Spark jobs for rosters: change feeds, entity linking, asset quality and study logs."""
