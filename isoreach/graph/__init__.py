"""Graph operators: iterative loops over DataFrames."""
