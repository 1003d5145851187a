"""Pactum: data contracts, snapshot diffs and change propagation on Spark tables and streams."""

__version__ = "0.1.0"
