"""Table and model operators; each is a function of DataFrames."""
