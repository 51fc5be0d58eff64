"""Table operators, DataFrame in and DataFrame out."""
