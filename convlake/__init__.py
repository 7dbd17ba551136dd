"""convlake: conversational-dataset preparation, audit and scoring as Spark DataFrame jobs."""
