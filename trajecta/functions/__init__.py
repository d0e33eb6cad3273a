"""Part of trajecta."""
