"""tidemark: reconciliation and analytics of dated value series on Spark DataFrames."""
