"""The analytics, one module per job; every operator takes and returns DataFrames."""
