"""shelfline: retail demand analytics expressed as Spark DataFrame jobs."""
