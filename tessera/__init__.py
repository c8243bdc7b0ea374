"""Spark-first analytics for scored image patches and, in ``tessera.llm``, for training corpora."""
