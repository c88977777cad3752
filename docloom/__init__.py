"""docloom: document retrieval and answer analytics as Spark DataFrames."""
