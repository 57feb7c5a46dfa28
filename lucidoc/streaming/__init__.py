"""Job intake and state as streams."""
