"""catalith: catalogue search, price series, similarity search and entity resolution as Spark DataFrame operators."""
