"""Column functions and small models: record codecs, Bloom filters, block layout, cache simulation."""
