"""Relational, vector, ranking, memory and metering operators: DataFrame in, DataFrame out."""
