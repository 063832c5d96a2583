"""Panels of monthly series, analysed as Spark plans."""
