"""Training-data operators: encoding, scans, packing, fingerprints, classifiers, dedup, sharding."""
