"""Functions of the library under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemill.operators.grids import sobol_points
from tidemill.operators.stats import correlation_p


@F.udtf(returnType="id bigint, u array<double>")
class SobolPoints:
    """Rows (id, u) of ``n`` low-discrepancy points in ``dims`` dimensions from number ``start`` on."""

    def eval(self, start: int, n: int, dims: int, seed: int) -> Iterator[tuple[int, list[float]]]:
        import numpy as np

        for k in range(start, start + n, 4096):
            index = np.arange(k, min(k + 4096, start + n))
            for i, u in zip(index, sobol_points(index, dims, seed)):
                yield int(i), u.tolist()


def register(spark: SparkSession) -> None:
    """Makes ``correlation_p(rho, n)`` and the table function ``sobol_points(start, n, dims, seed)`` known to SQL."""
    spark.udf.register("correlation_p", correlation_p)
    spark.udtf.register("sobol_points", SobolPoints)
