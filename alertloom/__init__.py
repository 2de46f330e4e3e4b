"""alertloom: security-alert analytics on Spark DataFrames."""
