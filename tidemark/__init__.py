"""Opinion and price-event analytics expressed as Spark DataFrame plans."""
