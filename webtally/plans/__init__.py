"""Which report runs on which table with which arguments, and the SQL each is checked against."""
