"""Operators of a training-data pipeline over a table of documents.

Every operator takes a DataFrame with an id column and a text column (other
columns are ignored, whatever their names) and returns a DataFrame. Nothing
else in the library imports this subpackage.
"""
