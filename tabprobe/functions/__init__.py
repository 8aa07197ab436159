"""Shared column expressions and two-pass building blocks used by the operators."""
