"""Sources and sinks: parquet tables, CSV scan/export, materialised cleaned tables, saved parameters."""
