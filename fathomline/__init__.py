"""fathomline: whole-program analyses as Spark dataframes, fixpoints and joins."""

__version__ = "0.1.0"
