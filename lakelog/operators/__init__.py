"""Evaluation: clauses as joins over DataFrames, fixed points, and a local path for small inputs."""
