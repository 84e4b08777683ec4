"""Named query plans: each is a Spark builder plus (where SQL can express
it) the equivalent DuckDB SQL used as the correctness oracle."""

from .registry import QUERIES, ORACLE_SQL, query

__all__ = ["QUERIES", "ORACLE_SQL", "query"]
