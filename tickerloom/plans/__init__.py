"""The ready-made queries, composed from the operators."""
