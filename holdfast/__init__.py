"""Subscription-retention analytics as Spark jobs."""
