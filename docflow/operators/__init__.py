"""Table operators, one module a family; each takes and returns DataFrames."""
