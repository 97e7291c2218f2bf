"""DataFrame operators: search, lookup, books."""
