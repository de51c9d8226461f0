"""kickoff — point-in-time analytics for two-sided dated contests on Spark.

Everything is DataFrame in, DataFrame out. Sub-packages:

* ``sources``   – table readers, the derived contest table, season files, fixtures
* ``functions`` – column expressions (calendar, prices, keys)
* ``operators`` – reusable relational building blocks (team-long view, time-blocked
  windows, Elo fold, as-of lookup, aggregates, splits, statistics)
* ``plans``     – composed jobs (feature build, model-ready table, scoring, training, EDA)
* ``streaming`` – Structured Streaming jobs on the event table
"""

__all__ = ["session"]


def _ship_by_value() -> None:
    """Pickle this package's functions (UDFs, grouped-map and mapInPandas folds) by value, so
    executors need no installed copy of the package."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
