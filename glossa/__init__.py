"""Lexical analytics on PySpark: dictionary-style indexes, searches and text decoding as DataFrame plans."""
