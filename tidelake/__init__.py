"""A change-data lake on Spark: change logs and snapshots to mirrors, history, and health."""
