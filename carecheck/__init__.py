"""carecheck: validation, compliance scoring, profiling, de-identification and
quality monitoring of healthcare tables as Spark DataFrame operators."""

__version__ = "0.1.0"
