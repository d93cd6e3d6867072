"""Training-data operators: filters, scans, duplicate removal, packing, sharding, tokenisation."""
