"""gridwright: profiling, preparation, model selection and evaluation of tables on Spark."""

__version__ = "0.1.0"
