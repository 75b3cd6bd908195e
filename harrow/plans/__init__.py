"""Configurations, model protocols, pipelines and experiments."""
