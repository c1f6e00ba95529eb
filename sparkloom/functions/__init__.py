"""Scalar and aggregate functions: names and dialect differences made explicit."""
