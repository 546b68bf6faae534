"""Evaluation of anomaly and intrusion detectors on flow and telemetry tables, in PySpark."""
__version__ = "0.1.0"
