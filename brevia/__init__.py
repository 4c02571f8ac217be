"""Text-pair preparation, evaluation and beam decoding as Spark DataFrame operators."""
