"""DataFrame operators: joins, rollups, scans over ordered rows, windows."""
