"""quern: an analytics engine that keeps to the DataFrame and SQL API of Spark."""
