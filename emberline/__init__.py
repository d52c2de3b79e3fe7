"""emberline: survey-to-event linkage and response modelling on Spark DataFrames."""

__version__ = "0.1.0"
