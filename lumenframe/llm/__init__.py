"""Training-data operators: one module per operator, plus the thin queries that apply them to whole tables."""
