"""logsift.streaming."""
