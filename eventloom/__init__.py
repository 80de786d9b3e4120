"""Hourly host features, quality reports and risk models over security event logs, on Spark."""
