"""strandflow: alignment and similarity-graph analytics over ordered sequences of vectors, on PySpark."""
