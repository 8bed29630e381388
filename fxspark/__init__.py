"""fxspark: foreign-exchange market and event analytics as Spark DataFrame operators."""
