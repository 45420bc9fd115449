"""Column expressions shared by the reports. All are built-in Spark expressions; there is no Python UDF."""
