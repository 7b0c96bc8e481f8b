"""DataFrame operators: ordered scans, windows, groups, quantiles, lookups, encoding, folds, metrics, models."""
