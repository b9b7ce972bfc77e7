"""Training-data operators: language id, chat formatting, quality rules, personal data, fingerprints,
secret scans, source mixing, WARC, near-duplicates and packing. Nothing else in the library imports this package."""
