"""The star model (view, narrow fact access), ranking and join strategies."""
