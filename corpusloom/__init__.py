"""Document analytics as Spark plans: retrieval, text processing, evaluation and graph operators."""
