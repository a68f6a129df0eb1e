"""weftline: semi-structured documents to clean relational data, as Spark DataFrame plans."""
