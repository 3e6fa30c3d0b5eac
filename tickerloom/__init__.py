"""Spark-native market, news and ledger analytics."""
