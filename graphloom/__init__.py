"""graphloom: multi-type graphs and hypergraphs as DataFrames, and their partitioning."""
