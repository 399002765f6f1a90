"""Billing-anomaly analytics as composable Spark DataFrame transformations."""
