"""Query text, algebra, and its compilation to DataFrames."""
