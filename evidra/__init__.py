"""evidra: versioned evidence retrieval and document processing as Spark DataFrame plans."""

__version__ = "0.1.0"
