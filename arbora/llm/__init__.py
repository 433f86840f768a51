"""Training-data pipeline operators (deduplication, decontamination, sharding, ...)."""
