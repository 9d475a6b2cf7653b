"""tandem: paired text and vector collections as Spark DataFrames."""
