"""lumenyard: data trust and opportunity analytics as Spark DataFrame jobs."""
