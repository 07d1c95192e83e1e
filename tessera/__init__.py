"""Tessera: dataset audit, preparation and evaluation as Spark DataFrame operators."""
