"""cairn: a PySpark-native engine for review-driven catalogues and recommendations."""
