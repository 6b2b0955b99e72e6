"""Research analytics on PySpark: panels, factors, cross-sections, as-of joins, labels and metrics."""
