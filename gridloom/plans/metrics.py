"""A ledger of scans: what each was asked and chose to read; and what the scans of a query that has run did read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query_id string, scan_id long, metrics string"
_ledger: list[tuple[str, int, dict]] = []
#: Scans that are remembered.
KEPT = 1024


def record(query: str, facts: dict) -> int:
    """Adds a scan and returns its id."""
    scan_id = _ledger[-1][1] + 1 if _ledger else 1
    _ledger.append((query, scan_id, {"schema_version": 4, "status": "planned", "residual_filter_retained": True, "index_bytes": None, "data_bytes": None} | facts))
    del _ledger[:-KEPT]
    return scan_id


def last_scan_metrics(spark: SparkSession) -> DataFrame:
    """(query_id, scan_id, metrics) of the scans of the last query that was built."""
    last = _ledger[-1][0] if _ledger else None
    return spark.createDataFrame([(q, i, json.dumps(m, sort_keys=True)) for q, i, m in _ledger if q == last], SCHEMA)


def _scans(node, found: list) -> None:
    """File scans below a node of a physical plan, through the stages of adaptive execution."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _scans(node.executedPlan(), found)
    if kind.endswith("QueryStageExec"):
        return _scans(node.plan(), found)
    if kind == "FileSourceScanExec":
        found.append(node)
    children = node.children()
    for i in range(children.size()):
        _scans(children.apply(i), found)
    return None


def finished_scan_metrics(df: DataFrame) -> DataFrame:
    """(status, rows_read, bytes, files, scan_complete) of each file scan of a DataFrame, from the counters that its last
    action on this very object left: ``bytes`` are those of the files that were read. A scan is complete unless it gave
    fewer rows than the last scan that was built may need: a LIMIT that had enough stops it early."""
    found: list = []
    _scans(df._jdf.queryExecution().executedPlan(), found)
    least = _ledger[-1][2].get("candidate_rows") if _ledger and _ledger[-1][2].get("table") else None
    rows = []
    for node in found:
        metrics = node.metrics()
        value = lambda name, metrics=metrics: metrics.apply(name).value() if metrics.contains(name) else None
        read, size, files = value("numOutputRows"), value("filesSize"), value("numFiles")
        status = "finished" if files else "planned"
        rows.append((status, read, size, files, None if least is None or status == "planned" else read >= least))
    return df.sparkSession.createDataFrame(rows, "status string, rows_read long, bytes long, files long, scan_complete boolean")
