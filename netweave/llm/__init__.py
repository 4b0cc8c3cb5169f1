"""Training-data operators: dedup, sharding, tokenised output, search,
language identification, quality, packing, decontamination, licence scans."""
