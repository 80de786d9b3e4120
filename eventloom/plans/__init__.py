"""Whole jobs: logs to cleaned tables, cleaned tables to features, features to models and scores."""
