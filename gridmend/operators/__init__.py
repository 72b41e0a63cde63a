"""Relational, graph, hazard, supply, economic and simulation operators over DataFrames."""
