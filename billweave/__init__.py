"""Bill and quotation analytics on Spark DataFrames."""
