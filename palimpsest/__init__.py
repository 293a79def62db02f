"""palimpsest: find, resolve and overwrite personal data in text held in Spark DataFrames."""
