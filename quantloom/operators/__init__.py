"""Operators on bars, events, grids and ledgers."""
