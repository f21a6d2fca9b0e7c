"""Gridded-observation and ground-monitor analytics as Spark DataFrame operators."""
