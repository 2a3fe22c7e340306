"""Tessera: personalised search, ranking and evaluation analytics as Spark plans."""
