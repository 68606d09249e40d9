"""Column functions: sentinels, known-ness, identifiers, text clean-up, geometry."""
