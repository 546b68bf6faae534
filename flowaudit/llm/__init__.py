"""Training-data operators: ten numbered operators and the queries that apply them."""
