"""logsift.sources."""
