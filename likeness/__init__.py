"""Near-duplicate sentence detection as Spark DataFrame transformations.

``functions``  column expressions and Arrow UDFs,
``operators``  DataFrame -> DataFrame steps (lazy, no actions),
``plans``      the steps wired into whole jobs, with the size checks that pick
               between a plan for bounded groups and one for hot groups,
``sources``    text and parquet readers and writers.
"""

from likeness.params import MinHashParams, ProjectionParams

__all__ = ["MinHashParams", "ProjectionParams"]
