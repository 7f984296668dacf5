"""Part of the change-stream engine."""
