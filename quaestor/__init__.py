"""quaestor: analytics over nested, slowly changing document data, on Spark DataFrames."""
