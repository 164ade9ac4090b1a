"""Nothing yet: a total order needs all rows, and Structured Streaming has no sort in append mode."""
