"""Columns: time buckets, monoids, value buckets, keys."""
