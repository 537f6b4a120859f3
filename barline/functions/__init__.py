"""Scalar expressions as Columns; all stay inside code generation."""
