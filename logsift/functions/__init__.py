"""logsift.functions."""
