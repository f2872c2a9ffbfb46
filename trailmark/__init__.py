"""Trailmark: analytics over recorded web traffic, written for Spark."""

__version__ = "0.1.0"
