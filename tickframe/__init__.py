"""Market-data lakehouse operators for PySpark."""
