"""matchloom: policy-driven matching and capacity allocation as Spark DataFrame jobs."""

__version__ = "0.1.0"
