"""Column-level building blocks (no DataFrame, no session needed)."""
