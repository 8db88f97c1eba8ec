"""xylem: XML collections as distributed tables on PySpark."""
