"""All queries of the library by name, with their SQL."""

import functools

from ..sources.tables import limit_batches
from . import audit_queries, binary_queries, text_queries


def _limited(run):
    """run, with small batches for the Python workers."""

    @functools.wraps(run)
    def call(spark, sf_dir):
        limit_batches(spark)
        return run(spark, sf_dir)

    return call


QUERIES = {name: _limited(run) for name, run in (text_queries.Q | audit_queries.Q | binary_queries.Q).items()}
ORACLE_SQL = text_queries.SQL | audit_queries.SQL | binary_queries.SQL
