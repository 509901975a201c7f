"""weftline: retrieval, graph, event and evaluation operators over Spark DataFrames."""
