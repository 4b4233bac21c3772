"""Point-cloud recognition and table analytics expressed as Spark DataFrame plans."""
