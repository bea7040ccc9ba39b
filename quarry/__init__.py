"""PySpark-native analytics over public-company filings."""
