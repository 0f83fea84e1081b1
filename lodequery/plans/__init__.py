"""Query plans: how the library operators are put together for the catalogue."""
