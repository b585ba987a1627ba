"""The read side: plans that merge state buckets into answers."""
