"""Inventory and rental analytics as Spark DataFrame operators."""
