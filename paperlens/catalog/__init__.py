"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

QUERIES = {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


def load():
    from paperlens.catalog import context, findings, records, streams, structure  # noqa: F401

    return QUERIES
