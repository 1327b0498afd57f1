"""Opencode stores as exported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas

TABLES = {
    "session": schemas.OPENCODE_SESSION,
    "message": schemas.OPENCODE_MESSAGE,
    "part": schemas.OPENCODE_PART,
}


def scan_opencode(session: DataFrame, message: DataFrame, part: DataFrame) -> dict[str, DataFrame]:
    """Exported tables cut to the columns the library reads, with their types."""
    given = {"session": session, "message": message, "part": part}
    return {
        t: df.select(*[
            df[name].cast(kind).alias(name)
            for name, kind in (c.strip().split(" ") for c in TABLES[t].split(","))
        ])
        for t, df in given.items()
    }
