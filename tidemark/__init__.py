"""Telemetry, map, search and corpus analytics as Spark DataFrames."""
