"""Query operators as functions of DataFrames."""
