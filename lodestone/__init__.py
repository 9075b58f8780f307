"""lodestone: retrieval, knowledge and corpus analytics expressed as Spark DataFrame plans."""
