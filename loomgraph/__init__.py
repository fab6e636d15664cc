"""loomgraph: retrieval, graph, memory-maintenance and corpus analytics as PySpark DataFrame plans."""
