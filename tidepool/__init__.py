"""Schedule, offer and alert analytics as named, deterministic DataFrame operators."""
