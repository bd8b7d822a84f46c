"""Analyses over contract rows; every function takes and returns DataFrames."""
