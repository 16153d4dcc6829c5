"""gridspark: gridded stress, prediction and supply-chain attribution as Spark DataFrame operators."""

__version__ = "0.1.0"
