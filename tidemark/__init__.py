"""Release-diff and code-usage analytics on PySpark."""
