"""Sources and sinks: CSV, TSV, population files, snapshots, tables."""
