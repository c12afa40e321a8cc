"""Analytics over document corpora and ranked retrieval, on PySpark."""
