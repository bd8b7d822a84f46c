"""Partitions of shuffles where tables grow."""

from __future__ import annotations

from tenderlake.session import _ADVISORY, _INITIAL, enough_partitions


def test_partitions_grow_with_the_scan(spark):
    before = spark.conf.get(_INITIAL, None)
    scan = spark.range(1 << 22).toDF("a")  # counted as 32 MB
    try:
        spark.conf.unset(_INITIAL)
        enough_partitions(scan)
        assert spark.conf.get(_INITIAL) == "16" and spark.conf.get(_ADVISORY[0]) == _ADVISORY[1]
        spark.conf.set(_INITIAL, "7")  # a session's own choice stays
        enough_partitions(scan)
        assert spark.conf.get(_INITIAL) == "7"
    finally:
        spark.conf.unset(_ADVISORY[0])
        spark.conf.unset(_INITIAL) if before is None else spark.conf.set(_INITIAL, before)
