"""Thermal-detection warehouse and multidimensional query layer on Spark DataFrames."""
