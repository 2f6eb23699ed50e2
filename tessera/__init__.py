"""tessera: retrieval, agent-memory and training-data analytics as PySpark DataFrame operators."""
