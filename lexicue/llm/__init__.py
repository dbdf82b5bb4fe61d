"""Training-data operators: mixing, fingerprints, sharding, archives, secrets, language, packing, scoring, joins, rules."""
