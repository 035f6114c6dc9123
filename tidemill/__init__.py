"""tidemill: document-corpus analytics on Spark DataFrames."""
