"""All registered queries: name -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

from workload import ingest, kpi, lifecycle, profiling, serving, storage

ALL = {**kpi.QUERIES, **ingest.QUERIES, **profiling.QUERIES, **serving.QUERIES, **lifecycle.QUERIES, **storage.QUERIES}
