"""Part of the marquetry engine."""
