"""Showtime, rating and weekly-report analytics as PySpark DataFrame operators."""
