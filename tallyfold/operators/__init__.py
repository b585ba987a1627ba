"""DataFrame operators: pipelines and presets, dedup and debounce, projection, reranking."""
