"""Column expressions: sequence letters, patterns, score normalisation."""
