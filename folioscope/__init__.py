"""Folioscope: document-corpus analytics as lazy PySpark DataFrame operators."""
