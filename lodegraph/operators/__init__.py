"""Operators over the graph, DataFrame in and DataFrame out."""
