"""Graph, demand, routing and hierarchy operators over DataFrames."""
