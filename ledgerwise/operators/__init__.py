"""Part of the billing-anomaly library; see the README for the map."""
