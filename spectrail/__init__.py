"""spectrail: a PySpark-native store and query engine for mass-spectrometry peak data."""

__version__ = "0.1.0"
