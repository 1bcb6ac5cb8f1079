"""verdigraph: document retrieval and grounded question answering on Spark DataFrames."""
