"""DataFrame operators: each takes and returns DataFrames and names the columns it reads."""
