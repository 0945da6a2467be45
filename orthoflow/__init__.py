"""orthoflow: Vietnamese spelling correction over Spark DataFrames."""
