"""Training-data operators: fingerprints, archives, scans, classifiers, media, mixing, packing, joins, line dedup."""
