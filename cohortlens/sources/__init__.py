"""Sources and sinks: fact tables -> cohort table, CSV/parquet cohort files, presets, result sinks."""
