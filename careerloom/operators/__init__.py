"""DataFrame operators, keyed by session."""
