"""examlytics: Spark-native analytics for transcribed exam papers."""

__version__ = "0.1.0"
