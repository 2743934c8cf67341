"""structlens: catalog, snapshot and interaction analytics expressed on Spark DataFrames."""
