"""SQL over change-data-capture logs and batch tables, on PySpark."""
