"""A governed analytics engine on Spark: declare a plan, get one lazy DataFrame."""

__version__ = "0.1.0"
