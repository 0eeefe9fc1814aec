"""Operators on observation tables: plain functions from DataFrames to DataFrames."""
