"""DataFrame operators: preparation, sampling, features, classifiers, search, metrics."""
