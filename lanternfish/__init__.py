"""Spark-first analytics over archives of dated, geolocated reports."""
