"""Column functions: geometry, sky pixels, special functions, interpolation, models and deterministic random draws."""
