"""termweave: terminology search, coding review and evaluation as Spark DataFrame jobs."""
