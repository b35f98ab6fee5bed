"""Column expressions and frame helpers shared by the operators."""
