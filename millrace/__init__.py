"""millrace: document retrieval, packing and evaluation analytics as PySpark DataFrame operators."""
