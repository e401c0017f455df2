"""Document-forensics analytics on Spark: facts, checks, scores and rankings over whole corpora."""

__version__ = "0.1.0"
