"""Spark jobs for endurance-activity recordings: many athletes, many rides, one row per sample."""
