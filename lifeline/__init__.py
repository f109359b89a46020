"""Process-lifecycle analytics as Spark jobs.

Inputs are tables or streams that collectors have already landed (process-table
scans, raw fork/exec/exit notices, loss counters). Everything here maps
DataFrames to DataFrames.
"""
