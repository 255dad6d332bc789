"""Lakeweave: pipeline metadata, lineage, warehouse patterns and bank-finance analytics as Spark DataFrame jobs."""
