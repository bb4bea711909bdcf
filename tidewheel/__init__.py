"""Scheduling analytics and corpus preparation on Spark."""
