"""Column expressions and the few Python functions used by the operators."""
