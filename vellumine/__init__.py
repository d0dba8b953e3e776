"""vellumine: text-material analytics expressed as Spark DataFrame and SQL plans."""
