"""Inflection rules and the deinflection plan."""
