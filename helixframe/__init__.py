"""helixframe: sequence analytics and text-collection processing as Spark DataFrame programs."""

__version__ = "0.1.0"
