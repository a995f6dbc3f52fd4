"""Road-sign inventory analytics on PySpark: operators, sources, plans and streams."""
