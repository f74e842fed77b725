"""millrace: a Spark-first engine for key/value dataflow jobs and batched tensor-graph scoring."""

__version__ = "0.1.0"
