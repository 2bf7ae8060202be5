"""Sources and sinks: parquet tables, snapshots, notifications, summary caches."""
