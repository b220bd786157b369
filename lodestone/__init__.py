"""lodestone: storage-telemetry and key-value analytics expressed on Spark SQL."""

__version__ = "0.1.0"
