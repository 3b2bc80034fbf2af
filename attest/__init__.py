"""attest: evidence and integrity analytics over tables, as Spark jobs."""

__version__ = "0.1.0"
