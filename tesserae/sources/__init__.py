"""Sources and sinks: repository trees, change logs, versioned snapshots."""
