"""Scalar functions: built-in column expressions, and Arrow functions where no built-in exists."""
