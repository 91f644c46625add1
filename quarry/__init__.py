"""A PySpark-native analytics engine: operators, sources, functions, plans and streams as DataFrame and SQL code."""
