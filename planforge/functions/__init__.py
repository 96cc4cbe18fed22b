"""Column expressions and encoders."""
