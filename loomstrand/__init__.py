"""loomstrand: long-read overlap, layout and consensus assembly as Spark DataFrame operators."""

__version__ = "0.1.0"
