"""Reading and writing datasets by location, table name or logical name."""
