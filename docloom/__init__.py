"""docloom: document ingest, retrieval, answering and evaluation as PySpark plans."""

__version__ = "0.1.0"
