"""Analysis and rebuilding of web-page corpora with PySpark DataFrames."""
