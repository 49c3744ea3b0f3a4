"""Analytics on Spark DataFrames: evidence-aware relational recipes, retrieval, readers, and corpus operators."""
