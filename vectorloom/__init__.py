"""vectorloom: relational operators for training data of vector models and retrieval analytics on PySpark."""

__version__ = "0.1.0"
