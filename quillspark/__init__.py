"""quillspark: document analytics, corpus mining and repair on Spark DataFrames."""
