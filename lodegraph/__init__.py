"""lodegraph: a Spark-native engine for graphs of symbols, search over them, and code-quality reports."""
