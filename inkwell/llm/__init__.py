"""Operators for preparing large text collections as training data.

Nothing outside this package imports it.  Each module holds one operator as functions from
DataFrames to DataFrames; ``queries`` registers them for the driver.
"""
