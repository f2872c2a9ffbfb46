"""Live captures: admission, de-duplication, caps per shape, and incremental builds.

The graph is one aggregation over contributions, so a micro-batch adds its partial aggregates and the graph is merged from
those of all batches; replaying a batch changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from trailmark.functions.classify import STATIC, is_probe
from trailmark.functions.domains import in_scope
from trailmark.operators import contributions as c
from trailmark.operators.fold import apply_folds, folded_paths
from trailmark.operators.partials import edge_partials, finished_nodes, merged_edges, merged_nodes, node_partials
from trailmark.tables import Store

PER_SHAPE = 10
FILES_PER_TRIGGER = 500
TRIGGER = "5 seconds"
SNAPSHOT_ROWS, SNAPSHOT_SECONDS = 40, 180


def admitted(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows that a live capture takes: no static files, and only hosts in scope if there is one."""
    keep = ~F.coalesce(F.substring_index("path", "?", 1).rlike(STATIC), F.lit(False))
    return rows.filter(keep & in_scope(F.col("host"), scope) if scope else keep)


def digest(columns: list[str]) -> Column:
    """SHA-256 over columns, told apart by their lengths."""
    parts = [F.concat(F.coalesce(F.length(F.col(x).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in columns]
    return F.sha2(F.concat(*parts), 256)


def deduplicated(rows: DataFrame, columns: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each digest.  With an event time, state older than ``late`` is dropped; else it is kept for good."""
    marked = rows.withColumn("digest", digest(columns))
    if event_time:
        return marked.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["digest"])
    return marked.dropDuplicates(["digest"])


def shape(extra: list[str] = ()) -> Column:
    """What makes requests alike: method, host, port, template, status, role and names of query parameters."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in ("method", "host", "port", "path_template", "status", "role")], F.concat_ws(",", F.array_sort("query_params")), *[F.col(x).cast("string") for x in extra])


def capped(rows: DataFrame, keys: list[str] | Column, order: str, most: int = PER_SHAPE) -> DataFrame:
    """The first ``most`` rows of each shape of a batch; tasks cut their part before the shuffle."""
    by = keys if isinstance(keys, list) else [keys]
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__k") <= most).drop("__k")


def capped_stream(rows: DataFrame, key: Column, most: int = PER_SHAPE) -> DataFrame:
    """The first ``most`` rows of each shape over a whole stream; the state is one count a shape."""
    names = rows.columns
    keyed = rows.withColumn("__shape", key)

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            yield pdf.iloc[: max(0, most - n)][names]
            n += len(pdf)
        state.update((min(n, most),))

    return keyed.groupBy("__shape").applyInPandasWithState(keep, rows.schema, "n long", "append", GroupStateTimeout.NoTimeout)


class IncrementalGraph:
    """A graph that grows by micro-batches under one folder.

    A batch's requests are reduced to partial nodes and edges, small and mergeable; ``FANIN`` neighbouring ranges of one size
    are merged into one, so what a batch costs grows with the batch and the logarithm of their number, and a reader merges
    a few tables.  Batches are numbered from 0; a batch that comes again replaces its own, unless it was merged already:
    then it is in.

    The partials hold for one scope, seed host and set of folded paths.  With ``fold``, the folds of all paths so far are
    looked at after each batch; when they change, as when the graph is opened with another scope or seed host, partials
    are built anew from the requests, which are kept.
    """

    FANIN = 8

    def __init__(self, path: str, scope: list[str], primary: str | None, fold: bool = False):
        self.path, self.scope, self.primary, self.fold = path, scope, primary, fold
        self.requests, self.paths = Store(f"{path}/requests"), Store(f"{path}/paths")
        self.rebuilds = 0

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark, own = batch.sparkSession, (batch_id, batch_id)
        if any(a <= batch_id <= b and a < b for a, b in self._nodes(self._settings(spark)).ranges(spark)):
            return
        self.requests.write(batch, own)
        batch = self.requests.read(spark, [own])
        if self.fold:
            plain = batch.filter((F.col("method") != "OPTIONS") & ~is_probe(F.col("method"), F.col("path"))).select("host", "path_template").distinct()
            self.paths.write(plain, own)
            self._merge(spark, self.paths, lambda df: df.distinct(), own)
        settings = self._settings(spark)
        states = self._nodes(settings), self._edges(settings)
        missing = [r for r in self.requests.ranges(spark) if not any(a <= r[0] and r[1] <= b for a, b in states[1].ranges(spark))]
        if len(missing) > 1:
            self.rebuilds += 1
            batch, own = self.requests.read(spark, missing), (missing[0][0], missing[-1][1])
        x = c.classified(self._folded(spark, batch), self.scope, self.primary)
        states[0].write(node_partials(c.node_contributions(x)), own)
        states[1].write(edge_partials(c.edge_contributions(x)), own)
        self._merge(spark, states[0], merged_nodes, own)
        self._merge(spark, states[1], merged_edges, own)

    def _merge(self, spark, store: Store, merged: Callable[[DataFrame], DataFrame], last: tuple[int, int]) -> None:
        """Merge the ranges at the end that are of one size, as long as there are enough of them."""
        while True:
            ranges = store.ranges(spark)
            size = ranges[-1][1] - ranges[-1][0] + 1
            alike = [r for r in ranges if r[1] - r[0] + 1 == size][-self.FANIN :]
            if len(alike) < self.FANIN or alike != ranges[-self.FANIN :]:
                return
            store.write(merged(store.read(spark, alike)), (alike[0][0], alike[-1][1]))
            for r in alike:
                store.drop(spark, r)

    def _folds(self, spark) -> DataFrame | None:
        ranges = self.paths.ranges(spark) if self.fold else []
        if not ranges:
            return None
        known = self.paths.read(spark, ranges).distinct()
        return folded_paths(known.select("host", "path_template", F.col("path_template").alias("path"), F.lit("GET").alias("method")))

    def _settings(self, spark) -> str:
        """A name for the scope, seed host and folds that partials hold for."""
        folds = self._folds(spark)
        mark = folds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("host", "base", "folded").cast("decimal(38,0)")), F.lit(0))).first() if folds is not None else (0, 0)
        return hashlib.sha256(repr((sorted(self.scope), self.primary, self.fold, int(mark[0]), int(mark[1]))).encode()).hexdigest()[:16]

    def _folded(self, spark, rows: DataFrame) -> DataFrame:
        folds = self._folds(spark)
        return rows if folds is None else apply_folds(rows, folds)

    def _nodes(self, settings: str) -> Store:
        return Store(f"{self.path}/nodes-{settings}")

    def _edges(self, settings: str) -> Store:
        return Store(f"{self.path}/edges-{settings}")

    def graph(self, spark) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) over all batches so far."""
        settings = self._settings(spark)
        nodes, edges = self._nodes(settings), self._edges(settings)
        if not nodes.ranges(spark):  # opened with other settings than those that were added with
            every = self.requests.ranges(spark)
            x = c.classified(self._folded(spark, self.requests.read(spark, every)), self.scope, self.primary)
            nodes.write(node_partials(c.node_contributions(x)), (every[0][0], every[-1][1]))
            edges.write(edge_partials(c.edge_contributions(x)), (every[0][0], every[-1][1]))
            self.rebuilds += 1
        return finished_nodes(merged_nodes(nodes.read(spark, nodes.ranges(spark)))), merged_edges(edges.read(spark, edges.ranges(spark)))


class SnapshotTimer:
    """Whether a snapshot is due: enough new rows, or enough time since the last one."""

    def __init__(self, rows: int = SNAPSHOT_ROWS, seconds: float = SNAPSHOT_SECONDS):
        self.rows, self.seconds, self.new, self.last = rows, seconds, 0, 0.0

    def due(self, added: int, now: float) -> bool:
        self.new += added
        if self.new and (self.new >= self.rows or now - self.last >= self.seconds):
            self.new, self.last = 0, now
            return True
        return False


def start(rows: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Run a live capture: ``add`` for each micro-batch; ``once`` takes what is there and ends."""
    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def watch(spark, path: str, schema, format_: str = "json", per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Files that arrive in a folder; names that begin with ``_`` or ``.`` are still being written and are skipped."""
    return spark.readStream.format(format_).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
