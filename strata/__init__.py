"""A Spark-native engine for evidence analytics: scans, joins, merges, ranking, scoring and delivery state as DataFrame jobs."""
