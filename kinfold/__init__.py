"""kinfold: record linkage and corpus processing as Spark DataFrame programs."""
