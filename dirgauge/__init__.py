"""dirgauge: analytics over file-system namespace snapshots, written for Spark."""

__version__ = "0.1.0"
