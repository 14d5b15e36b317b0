"""Lifecycle and transaction-forensics analytics expressed as Spark dataflow."""
