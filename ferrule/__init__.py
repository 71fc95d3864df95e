"""ferrule: document accessibility audits and usage analytics as PySpark operators."""
