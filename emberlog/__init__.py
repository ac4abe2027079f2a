"""emberlog: security-event analytics and data-quality operators on PySpark DataFrames."""
