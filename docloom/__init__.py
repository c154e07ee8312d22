"""docloom: document-intelligence and retrieval analytics as PySpark DataFrame plans."""
