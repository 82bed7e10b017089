"""weft: code-graph analytics and corpus preparation as PySpark DataFrame programs."""
