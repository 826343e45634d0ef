"""Query registry."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and its SQL check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
