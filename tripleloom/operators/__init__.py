"""The engine's operators, grouped by what they work on."""
