"""Publication of bounded documents with checksums and a dated copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.operators.governance import scan_sensitive
from voltmill.sources.tables import file_checksums


class PublicationError(ValueError):
    """A document holds something that may not be published."""


def publish(frames: dict[str, DataFrame], path: str, date: str, check: bool = True) -> DataFrame:
    """Write every frame as JSON to ``latest/`` and ``history/date=…/``.

    Every frame is scanned first, so nothing is written when one is refused.
    Returns the checksum manifest, also stored as ``manifest``.
    """
    if not frames:
        raise ValueError("nothing to publish")
    if check:
        for name, frame in frames.items():
            # at most one row for each field and rule
            findings = scan_sensitive(frame).collect()
            if findings:
                where = ", ".join(f"{row.location}: {row.rule}" for row in findings)
                raise PublicationError(f"{name}: {where}")
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/latest/{name}")
        # the dated copy repeats the published bytes, not the query
        spark.read.schema(frame.schema).json(f"{path}/latest/{name}").write.mode("overwrite").json(
            f"{path}/history/date={date}/{name}"
        )
    document = F.regexp_extract("file", r"/latest/([^/]+)/", 1)
    files = file_checksums(spark, f"{path}/latest", "*.json").select(
        document.alias("document"), "file", "checksum", "size_bytes"
    )
    files.write.mode("overwrite").json(f"{path}/manifest")
    return files
