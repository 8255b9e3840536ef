"""DataFrame operators: DataFrame(s) -> DataFrame."""
