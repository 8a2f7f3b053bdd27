"""Record types as DDL."""

from __future__ import annotations

# timestamp is epoch seconds
SENSOR_READING = "id STRING, timestamp BIGINT, temperature DOUBLE"
