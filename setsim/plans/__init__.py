"""How joins are put together: materialised stages, strategies, timing."""
