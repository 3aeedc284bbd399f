"""Search operators: DataFrame of items in, DataFrame of items out."""
