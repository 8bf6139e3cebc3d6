"""Batch jobs on Spark for large collections of pitch contours."""
