"""cohortlens: subscription product analytics as Spark jobs.

Each job is a function from DataFrames to a DataFrame, built only from
built-in Spark SQL expressions so that Catalyst plans it and Tungsten runs
it in whole-stage code generation.  See README.md for the job list.
"""

from cohortlens.sources.tables import Tables, load_driver_tables

__all__ = ["Tables", "load_driver_tables"]
