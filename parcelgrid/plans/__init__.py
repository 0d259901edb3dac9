"""Domain jobs built from the operators."""
