"""locusflow: population-genomics analytics as Spark DataFrame plans."""
