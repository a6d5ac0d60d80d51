"""Loyalty analytics for hotel chains, expressed as Spark DataFrame operators."""
