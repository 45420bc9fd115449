"""Reports: functions from DataFrames and plain arguments to a DataFrame."""
