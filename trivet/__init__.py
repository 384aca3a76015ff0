"""Spark-native triage of credential-like findings, with dataset curation and reporting."""
