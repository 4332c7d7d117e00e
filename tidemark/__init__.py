"""Portfolio analytics over long (date, asset, value) panels as Spark DataFrame plans."""
