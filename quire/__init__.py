"""quire: document analytics expressed as Spark DataFrame plans."""
