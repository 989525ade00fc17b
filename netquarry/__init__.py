"""netquarry: budgeted network sampling and graph analytics on Spark DataFrames."""
