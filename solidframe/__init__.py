"""solidframe: solid archives and large text corpora as Spark DataFrames."""
