"""Dataset analytics and curation operators as composable PySpark DataFrame functions."""
