"""Column functions of the models."""
