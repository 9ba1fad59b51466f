"""The operators: each takes DataFrames or Columns and returns lazy ones."""
