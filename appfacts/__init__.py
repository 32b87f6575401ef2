"""Operators over fact tables about collections of mobile apps, as Spark DataFrame jobs."""
