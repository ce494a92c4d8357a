"""Trackloom: movement analytics as Spark plans."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
