"""failscope: a PySpark-native engine for analysing failed agent runs."""

__version__ = "0.1.0"
