"""matchloom: record linkage and analytics expressed as Spark DataFrame plans."""
