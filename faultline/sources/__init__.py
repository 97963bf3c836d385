"""Reading log and CSV files, the raw-log and incident tables, report exports."""
