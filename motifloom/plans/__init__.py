"""Ready-made queries over the operators."""
