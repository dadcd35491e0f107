"""DataFrame to DataFrame operators; no operator runs an action."""
