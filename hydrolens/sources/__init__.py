"""Sources and sinks: typed CSV scans, sinks, snapshots, resume, rejects."""
