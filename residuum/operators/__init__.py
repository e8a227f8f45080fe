"""DataFrame operators: preparation, encoding, splitting, models, ordering."""
