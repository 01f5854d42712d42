"""Training-data operators: one module per operator, plus ``queries`` which registers them."""
