"""Operation log, manifest and the durable store."""
