"""lightgraph: directional influence analytics on property graphs, on Spark DataFrames."""
