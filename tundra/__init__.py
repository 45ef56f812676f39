"""tundra: Spark-first statistics, ledger, keyed-store, format and spatial operators."""

__version__ = "0.1.0"
