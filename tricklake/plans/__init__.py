"""Registered queries of the bridge library: each module has Q (name -> query) and O (name -> DuckDB SQL)."""

from __future__ import annotations

from functools import wraps

from . import bidding, canonical, contracts, deals, documents, features, matchpoints, ratings, records, scoring, tables

MODULES = (tables, records, documents, canonical, deals, scoring, contracts, matchpoints, ratings, bidding, features)
#: bytes of bytecode beyond which the JVM runs a method without compiling it; Spark's own limit is 65 535, so its largest methods would be interpreted
HUGE_METHOD = 8000


def _compiled(run):
    """The query, with generated code in methods that the JVM compiles."""

    @wraps(run)
    def query(spark, sf_dir):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
        return run(spark, sf_dir)

    return query


QUERIES = {name: _compiled(run) for m in MODULES for name, run in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.O.items()}
