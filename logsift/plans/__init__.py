"""logsift.plans."""
