"""Panel analytics on Spark: dense (time x instrument) panels, an expression language over them, factors and studies."""
