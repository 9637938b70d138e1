"""Message-risk and training-corpus analytics on Spark DataFrames."""
