"""The query providers: requests become lazy DataFrames."""
