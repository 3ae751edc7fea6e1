"""Task-oriented dialogue and agent-trace analytics on Spark DataFrames."""
