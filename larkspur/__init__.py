"""larkspur: PostgreSQL-style query semantics as PySpark DataFrame and SQL compositions."""
