"""DataFrame operators: joins, windows, events, statistics, sampling, quality."""
