"""Reading files and workbooks, and storing tables."""
