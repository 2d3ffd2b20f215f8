"""tarn: a Spark-first engine for multiple-choice evaluation analytics and corpus preparation."""

__version__ = "0.1.0"
