"""Daily risk panels, text signals and forecast evaluation as Spark DataFrame operators."""
