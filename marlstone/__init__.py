"""marlstone: retrieval, text-quality and knowledge-analytics operators for PySpark."""
