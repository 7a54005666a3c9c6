"""logsift.operators."""
