"""Scalar column functions; all are Spark built-ins, so they stay inside code generation."""
