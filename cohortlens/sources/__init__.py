"""Sources and sinks: typed input tables, the driver-table mapping, golden
result CSVs and Parquet/CSV writers."""
