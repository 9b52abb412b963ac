"""DataFrame operators: lazy unless the docstring says an action runs."""
