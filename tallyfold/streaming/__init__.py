"""State tables, micro-batch runtime, bootstrap, replay and metrics."""
