"""Set-oriented operators over the engine's tables."""
