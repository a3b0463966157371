"""Independent SQL statements that the Spark results are compared with."""
