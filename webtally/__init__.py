"""Web-analytics reports written as plain PySpark DataFrame functions."""
