"""newsloom: PySpark-native analytics for newsroom documents, filings and feeds."""
