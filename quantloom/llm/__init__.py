"""Training-data operators: scoring, de-duplication, mixing, scanning and token output."""
