"""DataFrame -> DataFrame operators: relational steps and spatial joins."""
