"""The index: a stored graph kept equal to a tree of files, by full build, by sync, or by a stream of changes.

References are stored as well. Only changed files are parsed again, and postings and token counts are replaced for their
symbols alone. But search ranks and inverse document frequencies depend on all symbols: after a change all references
are resolved anew, each name once, so that an index after any number of syncs equals one that was built from nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, resolve, search, semantic
from ..plans.steps import materialize, scope
from ..sources import files as src
from ..sources.store import Store, connected, last_per_key, upsert, without_files
from . import watch

#: Files that could not be parsed are all counted; so many are named in a run's report.
NAMED_ERRORS = 100
Progress = Callable[[str, int], None]


class Index:
    """A graph in a ``Store``, with the operations that maintain it."""

    def __init__(self, spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_bytes: int = src.MAX_BYTES) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.exclude, self.max_bytes = exclude, max_bytes

    def build(self, files: DataFrame, force: bool = False, progress: Progress | None = None) -> dict:
        """Index the discovered files; with ``force`` all of them, else those that changed. Returns what ``sync`` does."""
        if force:
            self.store.reset()
        return self.sync(files, progress)

    def sync(self, files: DataFrame, progress: Progress | None = None) -> dict:
        """Make the index equal to the files: classify, drop what is gone or stale, extract what is new.

        Returns counts of files by status, of new symbols and of errors, the first errors (file_path, error), and
        duration_ms. ``progress`` is called with a phase (scanning, parsing, resolving, done) and a number of files.
        """
        began, tell = time.time(), progress or (lambda phase, n: None)
        tell("scanning", 0)
        with scope(self.spark):
            status = materialize(src.classify_changes(files.drop("content"), self.store.read("files")))
            counted = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
            out = {k: counted.get(k, 0) for k in ("added", "modified", "removed", "unchanged")} | {"symbols": 0, "errors": 0, "failed": []}
            if out["added"] + out["modified"] + out["removed"]:
                stale = status.filter("status in ('removed', 'modified')").select("file_path")
                # Only the content of changed files is written.
                fresh = materialize(files.join(status.filter("status in ('added', 'modified')").select("file_path"), "file_path", "left_semi"))
                tell("parsing", out["added"] + out["modified"])
                out |= self._replace(stale, fresh, tell=tell)
        tell("done", sum(counted.values()))
        return out | {"duration_ms": round(1000 * (time.time() - began))}

    def apply_changes(self, changes: DataFrame, batch: tuple[str, int]) -> None:
        """One micro-batch (stream, number) of last states per file (path, op, ts, content): unlinks drop a file, others replace it.

        A change older than the one applied to its file last is left out, so changes may arrive out of order. An empty
        batch and one that was applied before change nothing.
        """
        if self.store.done(batch):
            return
        with scope(self.spark):
            ok = src.wanted(F.col("path"), F.octet_length(F.coalesce("content", F.lit(""))), self.exclude, self.max_bytes)
            before = self.store.read("applied")
            late = changes.join(before.withColumnRenamed("ts", "last"), "path", "left").filter("last is null or ts >= last or ts is null").drop("last")
            changes = materialize(late.filter(ok).select(F.col("path").alias("file_path"), "op", "content", "ts"))
            if not changes.limit(1).count():
                return
            fresh = materialize(src.with_facts(changes.filter("op <> 'unlink' and content is not null").select("file_path", "content")))
            marks = before.unionByName(changes.filter("ts is not null").select(F.col("file_path").alias("path"), "ts"))
            self._replace(changes.select("file_path"), fresh, batch, applied=last_per_key(marks.withColumn("at", F.col("ts")), ["path"], "at"))

    def watch(self, log: DataFrame, checkpoint: str, once: bool = True, gap: str = watch.DEBOUNCE) -> StreamingQuery:
        """Follow a streaming change log (path, op, ts, content)."""
        return watch.run(log, self.apply_changes, checkpoint, once, gap)

    def _replace(self, stale: DataFrame, fresh: DataFrame, batch: tuple[str, int] | None = None, tell: Progress = lambda phase, n: None, **more: DataFrame) -> dict:
        read = self.store.read
        rows = materialize(extract.parsed(fresh))
        found = materialize(extract.symbols(rows))
        counts = rows.filter("n >= 0").groupBy("file_path").agg(F.countDistinct("id").cast("int").alias("node_count"))
        old = read("symbols")
        gone = materialize(old.join(stale.distinct(), "file_path", "left_semi").select("id").unionByName(found.select("id")).distinct())
        symbols = materialize(old.join(gone, "id", "left_anti").select(old.columns).unionByName(found))
        refs = materialize(without_files(read("refs"), stale).unionByName(extract.refs(rows)))
        inside = connected(read("edges").filter("kind = 'contains'"), symbols).unionByName(extract.contains(rows)).dropDuplicates(["id"])
        # The symbols of other files keep their postings and token counts.
        postings = materialize(read("postings").join(gone, "id", "left_anti").select("id", "token", "tf", "size").unionByName(search.build_postings(found)))
        stats = materialize(search.statistics(symbols, postings))
        tokens = read("search_tokens").join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select("node_id", "token", "tf", "source")
        tokens = materialize(tokens.unionByName(semantic.term_frequency(semantic.token_counts(found)).select("node_id", "token", "tf", "source")))
        idf = semantic.idf(semantic.document_frequency(tokens), stats.select(F.col("n_all").alias("n")))
        tell("resolving", refs.count())
        resolved = resolve.resolve(refs, symbols, (postings, stats)).withColumn("metadata", F.lit(None).cast("string"))
        new_files = fresh.select("file_path", "hash", "language", "line_count").join(counts, "file_path", "left").select("file_path", "hash", "language", F.current_timestamp().alias("indexed_at"), F.coalesce("node_count", F.lit(0)).alias("node_count"), "line_count")
        files = upsert(without_files(read("files"), stale), new_files, ["file_path"])
        self.store.commit(batch, symbols=symbols, refs=refs, edges=upsert(inside, resolved, ["id"]), files=files, search_tokens=tokens, idf=idf, postings=postings, search_stats=stats, **more)
        failed = extract.errors(rows)
        return {"symbols": found.count(), "errors": failed.count(), "failed": [tuple(r) for r in failed.orderBy("file_path").limit(NAMED_ERRORS).collect()]}
