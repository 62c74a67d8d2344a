"""Evidence-backed claim graphs on PySpark: build, audit, rank and query them with DataFrames."""
