"""DataFrame to DataFrame operators; no I/O."""
