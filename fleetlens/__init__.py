"""Process-behaviour telemetry of many hosts as PySpark DataFrame operations."""
