"""Reading files and tables, and writing indexes."""
