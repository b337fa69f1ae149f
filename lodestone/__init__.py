"""Lodestone: dependency-graph, rule and corpus analytics on PySpark."""
