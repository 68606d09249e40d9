"""basinframe: subsurface project analytics expressed as Spark DataFrame operators."""
