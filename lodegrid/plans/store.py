"""The index on disk: segments of tables, upserts, and the hash gate.

A commit writes a folder of Parquet tables: rows that are new (a segment of each table), and which
owners' older rows it ends (files that changed, units that went).  Segments never change;
a table is its segments' rows that no later commit has ended.  What counts is listed in a small file that is
replaced at once, so readers are never in the way, and a commit that dies leaves nothing that is seen.
Bytes written follow the change.  Segments are merged as they fill up: where some of like sizes have come together, they become one,
so there are few of them and each row is written again a logarithmic number of times.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid import schemas
from lodegrid.operators import bm25, extraction
from lodegrid.operators import edges as edge_ops
from lodegrid.operators.resolve import LISTED, matching
from lodegrid.sources import files as source_files

NODE_ENRICHMENT = ("semantic_summary", "domain_tags", "inferred_responsibility", "enriched_at", "enrichment_model")


def gate(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content_hash, ...) that are new or whose content differs from what is known."""
    before = known.select("path", F.col("content_hash").alias("known_hash"))
    return scan.join(before, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("known_hash"))).drop("known_hash")


def gone(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Known files that the scan doesn't have."""
    return known.join(scan.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that is last in order; partial aggregates, no window."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def keep_enrichment(new: DataFrame, old: DataFrame) -> DataFrame:
    """New nodes with the enrichment of old ones that have their id and content."""
    before = old.select("id", "content_hash", *[F.col(c).alias(f"old_{c}") for c in NODE_ENRICHMENT])
    return new.drop(*NODE_ENRICHMENT).join(before, ["id", "content_hash"], "left").withColumnsRenamed({f"old_{c}": c for c in NODE_ENRICHMENT}).select(*new.columns)


def replace_nodes(old: DataFrame, new: DataFrame, paths: DataFrame, per: str = "node") -> DataFrame:
    """Nodes after a rebuild of files (path): theirs are new, the others stay.

    Enrichment of a rebuilt node is kept if its content is the same (``per`` 'node'), or
    dropped for all nodes of the file ('file').
    """
    kept = old.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*old.columns)
    return kept.unionByName((keep_enrichment(new, old) if per == "node" else new).select(*old.columns))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(nodes, edges, unenriched, enriched) in one row."""
    nodes = tables["nodes"].agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("enriched_at").isNull()).alias("unenriched"), F.count_if(F.col("enriched_at").isNotNull()).alias("enriched"))
    return nodes.crossJoin(tables["edges"].agg(F.count(F.lit(1)).alias("edges")))


#: Rows of a table lie in this order, so that a scan for some keys skips the others.
ORDER = {"nodes": ["file_path", "ord"], "lines": ["file_path", "line_no"], "mentions": ["word", "file_path"], "names": ["stem"], "edges": ["source_path"], "files": ["path"], "postings": ["term", "id"], "blocks": ["term"], "terms": ["term"]}
#: Bytes of the row groups of tables that are looked up by keys.
ROW_GROUP_BYTES = 4 << 20
#: Segments of like sizes, and files of ended owners of a table, before they are written as one.
FAN, ENDED_FILES = 4, 8
#: Bytes of parsed files up to which a commit's tables are sorted in one task, without sampling ranges.
SMALL = 16 << 20
#: Tables that a commit writes at a time: small jobs are mostly waiting.
WRITERS = 6
ENDED = "via string, owner string, segment int"


class Index:
    """An index in a folder: a local path, or the URI of any store that Spark's Hadoop can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.local = spark, "://" not in root
        self.root = os.path.abspath(root) if self.local else root.rstrip("/")
        self.uri = f"file://{self.root}" if self.local else self.root
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LISTED))

    def _hadoop(self, name: str = ""):
        """The store, and a path in it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _put(self, name: str, text: str) -> None:
        """A small file, whole or not at all: renamed into place locally, one object elsewhere."""
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            at = os.path.join(self.root, name)
            with open(f"{at}.new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{at}.new", at)
            return
        store, path = self._hadoop(name)
        out = store.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def exists(self) -> bool:
        store, path = self._hadoop("CURRENT")
        return store.exists(path)

    def state(self) -> dict:
        """What counts: the number of the last commit, each table's segments, and its files of ended owners."""
        if not self.exists():
            return {"schema_version": schemas.SCHEMA_VERSION, "commit": 0, "tables": {}, "ended": {}}
        return json.loads(self.spark.read.text(f"{self.uri}/CURRENT", wholetext=True).first()[0])

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One build at a time; BlockingIOError if another holds it.

        Locally the lock goes with its process.  In other stores it is an object that a build
        that died leaves behind, for ``reset`` to remove.
        """
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(os.path.join(self.root, "lock"), "w") as f:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                yield
            return
        store, path = self._hadoop("lock")
        if not store.createNewFile(path):
            raise BlockingIOError(self.root)
        try:
            yield
        finally:
            store.delete(path, False)

    def size(self, at: str) -> int:
        """Bytes of a folder."""
        store, path = self._hadoop(at)
        return store.getContentSummary(path).getLength() if store.exists(path) else 0

    def remove(self, name: str) -> None:
        """Delete a folder of the index."""
        store, path = self._hadoop(name)
        store.delete(path, True)

    def live(self, table: str, state: dict, segments: list[dict] | None = None) -> DataFrame:
        """A table's rows, with ``segment``, that no later commit has ended."""
        segments = state["tables"].get(table, []) if segments is None else segments
        schema = T.StructType([*schemas.TABLES[table].fields, T.StructField("segment", T.IntegerType())])
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.uri}/{s['at']}" for s in segments])
        ended = state["ended"].get(table, [])
        if ended and min(s["n"] for s in segments) < max(e["n"] for e in ended):
            gone_ = self.spark.read.schema(ENDED).parquet(*[f"{self.uri}/{e['at']}" for e in ended])
            for via in schemas.OWNERS[table]:
                last = gone_.where(F.col("via") == via).groupBy(F.col("owner").alias("ended_owner")).agg(F.max("segment").alias("ended_at"))
                rows = rows.join(last, (F.col(via) == F.col("ended_owner")) & (F.col("segment") < F.col("ended_at")), "left_anti")
        return rows

    def read(self) -> dict[str, DataFrame]:
        """The tables; empty ones where there is no commit yet."""
        state = self.state()
        if "commit" not in state:
            return self._read_older(state)
        return {n: self.live(n, state).drop("segment") for n in schemas.TABLES}

    def full_text(self) -> bm25.Stored:
        """The stored full-text index of nodes."""
        state = self.state()
        if "commit" not in state:
            tables = self._read_older(state)
            return bm25.Stored(*[tables[n] for n in ("postings", "blocks", "terms", "totals")])
        return bm25.Stored(*[self.live(n, state) for n in ("postings", "blocks", "terms", "totals")])

    def _read_older(self, state: dict) -> dict[str, DataFrame]:
        """The tables of an index of an older version; what it lacks is made from nodes and lines."""
        places = state.get("tables") or {n: state["snapshot"] for n in ("nodes", "edges", "files", "directories", "meta", "lines")}
        held = {n: self.spark.read.schema(schemas.TABLES[n]).parquet(f"{self.uri}/{places[n]}/{n}") for n in ("nodes", "files", "directories", "meta", "lines")}
        return held | derived(held["nodes"], held["lines"]) | text_tables(held["nodes"])

    def write(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Whole new contents of tables; of nodes, their full-text index and names follow, and edges if lines are given too."""
        commit = Commit(self)
        for n, rows in tables.items():
            commit.replace(n, rows)
        if "nodes" in tables:
            nodes = commit.written["nodes"]
            with ThreadPoolExecutor(WRITERS) as pool:
                text = pool.submit(commit.replace_text, nodes)
                names = commit.replace("names", edge_ops.names_of(nodes))
                if "lines" in tables:
                    words = commit.replace("mentions", edge_ops.sites(commit.written["lines"], nodes))
                    if "edges" not in tables:
                        commit.replace("edges", edge_ops.link(words, names, commit.written["lines"]))
                text.result()
        commit.done()
        return self.read()

    def upgrade(self) -> None:
        """Write an index of an older version anew, as this version stores it."""
        state = self.state()
        if "commit" not in state:
            tables = self._read_older(state)
            self.write({n: tables[n] for n in ("nodes", "files", "directories", "meta", "lines")})

    def schema_version(self) -> int:
        return self.state()["schema_version"] if self.exists() else 0

    def reset(self) -> None:
        store, path = self._hadoop()
        store.delete(path, True)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read()["meta"].collect()}

    def meta_table(self, values: dict[str, object]) -> DataFrame:
        new = self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], schemas.META)
        return upsert(self.read()["meta"], new, ["key"])

    def apply(self, changed: DataFrame, lost: DataFrame, token_limit: int = extraction.TOKEN_LIMIT, per: str = "node") -> list[tuple[str, str]]:
        """One commit for files that changed (path, text, ...) and files that went (path); warnings (path, warning).

        Nodes, lines and words of these files alone are made.  Edges are made for their lines and all names, and for other
        files' words and the names that these files define; those at either end of which one of the files stands are ended.
        A file that can't be parsed keeps its nodes, and is tried again by the next build.
        """
        self.upgrade()
        old, commit = self.read(), Commit(self)
        extracted = commit.stage("extracted", extraction.extract(changed, token_limit))
        failed = extraction.failures(extracted)
        touched = commit.stage("touched", changed.select("path").unionByName(lost.select("path")))
        replaced = commit.stage("replaced", touched.join(failed.select("path"), "path", "left_anti"))
        before = commit.stage("before", matching(old["nodes"], "file_path", replaced))
        commit.small = self.size(f"{commit.folder}/stage/extracted") < SMALL
        new = extraction.nodes_of(extracted)
        counts = extracted.where(~F.col("failed")).groupBy(F.col("file_path").alias("path")).agg(F.max("parsed").alias("node_count"))
        parsed = changed.join(failed.select("path"), "path", "left_anti").join(counts, "path", "left")
        rows = parsed.select("path", "last_modified", "content_hash", "language", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.current_timestamp().alias("indexed_at"))
        with ThreadPoolExecutor(WRITERS) as pool:
            made = {n: pool.submit(commit.add, n, rows) for n, rows in (("nodes", keep_enrichment(new, before) if per == "node" else new), ("lines", source_files.to_lines(changed)), ("files", rows))}
            ends = {n: {schemas.OWNERS[n][0]: replaced} for n in ("nodes", "files", "names")} | {n: {"file_path": touched} for n in ("lines", "mentions")}
            ends |= {"edges": {"source_path": touched, "target_path": replaced}, "postings": {"id": before.select("id")}}
            more = [pool.submit(commit.end, n, owners) for n, owners in ends.items()]
            nodes, lines = made["nodes"].result(), made["lines"].result()
            more += [made["files"], pool.submit(commit.add_text, nodes, before)]
            kept = matching(old["nodes"], "file_path", failed.select("path"))
            named, worded = pool.submit(commit.add, "names", edge_ops.names_of(nodes)), pool.submit(commit.add, "mentions", edge_ops.sites(lines, nodes.unionByName(kept)))
            names, words = named.result(), worded.result()
            others = matching(old["names"], "stem", words.select("word")).join(replaced, F.col("target_path") == F.col("path"), "left_anti").unionByName(names)
            users = matching(old["mentions"], "word", names.select("stem")).join(touched, F.col("file_path") == F.col("path"), "left_anti")
            text = lines if names.where(~F.col("plain")).isEmpty() else old["lines"]
            commit.add("edges", edge_ops.link(words, others, lines).unionByName(edge_ops.link(users, names, text)))
            for f in more:
                f.result()
        warnings = [(r["path"], r["warning"]) for r in failed.orderBy("path").collect()]
        commit.done()
        return warnings

    def enriched(self, nodes: DataFrame) -> dict[str, DataFrame]:
        """One commit of nodes (id and all columns) in place of those of their ids: no prompt is asked twice for it.

        The rows are written first and read again for all else.  Their ids, names and spans are as before, so edges stay.
        """
        self.upgrade()
        commit, old = Commit(self), self.read()
        answered = commit.stage("answered", nodes)
        commit.small = self.size(f"{commit.folder}/stage/answered") < SMALL
        paths = answered.select("file_path").distinct()
        before = commit.stage("before", matching(old["nodes"], "file_path", paths))
        # A file's rows are ended together, so its other nodes are written again with them.
        rest = before.join(answered.select("id"), "id", "left_anti").select(*before.columns)
        new = commit.add("nodes", rest.unionByName(answered.select(*before.columns)))
        commit.end("nodes", {"file_path": paths})
        commit.add_text(new.join(answered.select("id"), "id", "left_semi"), before.join(answered.select("id"), "id", "left_semi"))
        commit.end("postings", {"id": answered.select("id")})
        commit.done()
        return self.read()

    def build(self, root: str, phase: str = "PREPARE", token_limit: int = extraction.TOKEN_LIMIT, exclude: list[str] | None = None, per: str = "node") -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
        """Index a tree of files, parsing those that changed; the tables, and warnings (path, warning)."""
        with self.lock():
            self.upgrade()
            patterns = source_files.gitignore(root) + list(exclude or [])
            found, warned = source_files.indexable(source_files.scan(self.spark, root), patterns)
            for row in source_files.undecodable(source_files.scan(self.spark, root), patterns).orderBy("path").toLocalIterator():
                print(f"skipped, not UTF-8: {row['path']}", file=sys.stderr)
            found, known = found.cache(), self.read()["files"]
            changed, lost = gate(found, known).cache(), gone(found, known).select("path")
            warnings = [(r["path"], r["warning"]) for r in warned.collect()]
            if not (changed.isEmpty() and lost.isEmpty()):
                warnings += self.apply(changed, lost, token_limit, per)
            changed.unpersist()
            found.unpersist()
            tables = self.read()
            row = summary(tables).first()
            values = {"last_full_build": datetime.now(UTC).isoformat(), "total_nodes": row["nodes"], "total_edges": row["edges"], "unenriched_nodes": row["unenriched"], "last_phase_boundary": phase, "schema_version": schemas.SCHEMA_VERSION}
            return self.write({"meta": self.meta_table(values)}), sorted(warnings)


def derived(nodes: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Names, words and edges of whole nodes and lines."""
    names, words = edge_ops.names_of(nodes), edge_ops.sites(lines, nodes)
    return {"names": names, "mentions": words, "edges": edge_ops.link(words, names, lines)}


def text_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The full-text index of whole nodes."""
    postings = bm25.ordered(bm25.indexed(nodes))
    blocks = bm25.block_bounds(postings)
    return {"postings": postings, "blocks": blocks, "terms": blocks.groupBy("term").agg(F.sum("n").alias("n")), "totals": text_totals(nodes)}


def text_totals(nodes: DataFrame) -> DataFrame:
    """One row: nodes, and tokens in them."""
    tokens = bm25.text_lengths(nodes).agg(F.sum("length").alias("tokens"))
    return nodes.agg(F.count(F.lit(1)).alias("docs")).crossJoin(tokens).select("docs", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def tail_bytes(segments: list[dict]) -> int:
    return sum(s["bytes"] for s in segments)


class Commit:
    """A new state of an index in the making: tables are written as they come, and count once it is done."""

    def __init__(self, index: Index):
        self.index, self.state = index, index.state()
        if "commit" not in self.state:
            self.state = {"commit": 0, "tables": {}, "ended": {}}
        self.n = self.state["commit"] + 1
        self.folder = f"commit-{self.n:08d}-{uuid.uuid4().hex[:8]}"
        self.written: dict[str, DataFrame] = {}
        self.new: dict[str, dict] = {}
        self.ended: dict[str, dict] = {}
        self.replaced: set[str] = set()
        self.small = False

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows that only this commit reads, and return them as read again."""
        at = f"{self.index.uri}/{self.folder}/stage/{name}"
        rows.write.parquet(at)
        return self.index.spark.read.schema(rows.schema).parquet(at)

    def _write(self, name: str, table: str, rows: DataFrame, n: int) -> tuple[dict, DataFrame]:
        fields = schemas.TABLES[table].fields
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.lit(n).alias("segment"))
        if self.small:
            out = out.coalesce(1)
        if table in ORDER and table != "postings":  # postings come in order
            out = (out if self.small else out.repartitionByRange(*ORDER[table])).sortWithinPartitions(*ORDER[table])
        at = f"{self.folder}/{name}"
        out.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", 2_000).parquet(f"{self.index.uri}/{at}")
        entry = {"at": at, "n": n, "bytes": self.index.size(at)}
        return entry, self.index.live(table, {"ended": {}}, [entry])

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """New rows of a table, written and read again."""
        self.new[table], live = self._write(table, table, rows, self.n)
        self.written[table] = live.drop("segment")
        return self.written[table]

    def replace(self, table: str, rows: DataFrame) -> DataFrame:
        """``add``, and all older rows of the table end."""
        self.replaced.add(table)
        return self.add(table, rows)

    def end(self, table: str, owners: dict[str, DataFrame]) -> None:
        """End the older rows of owners, by column."""
        rows = [o.select(F.lit(via).alias("via"), F.col(o.columns[0]).alias("owner"), F.lit(self.n).alias("segment")) for via, o in owners.items()]
        at = f"{self.folder}/ended-{table}"
        reduce(DataFrame.unionByName, rows).distinct().coalesce(1).write.parquet(f"{self.index.uri}/{at}")
        self.ended[table] = {"at": at, "n": self.n}

    def add_text(self, nodes: DataFrame, before: DataFrame) -> None:
        """The full-text index of new nodes, and what those before them take off its sums."""
        with ThreadPoolExecutor(2) as pool:
            sums = pool.submit(self.add, "totals", text_totals(nodes).unionByName(text_totals(before).select((-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))))
            blocks = self.add("blocks", bm25.block_bounds(self.add("postings", bm25.ordered(bm25.indexed(nodes), self.small))))
            less = bm25.postings(before).groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
            terms = blocks.groupBy("term").agg(F.sum("n").alias("n")).unionByName(less).groupBy("term").agg(F.sum("n").alias("n"))
            self.add("terms", terms.where("n <> 0"))
            sums.result()

    def replace_text(self, nodes: DataFrame) -> None:
        self.replaced |= {"postings", "blocks", "terms", "totals"}
        self.add_text(nodes, nodes.limit(0))

    def _next(self) -> dict:
        tables, ended = {}, {}
        for t in schemas.TABLES:
            before = [] if t in self.replaced else self.state["tables"].get(t, [])
            tables[t] = before + ([self.new[t]] if t in self.new else [])
            ended[t] = [] if t in self.replaced else self.state["ended"].get(t, []) + ([self.ended[t]] if t in self.ended else [])
        return {"schema_version": schemas.SCHEMA_VERSION, "commit": self.n, "tables": tables, "ended": ended}

    def done(self) -> None:
        """Merge what is due, make the new state count, and delete what neither it nor the last one needs."""
        index, before = self.index, self.state
        state = self._next()
        self._merge(state)
        index._put("CURRENT", json.dumps(state))
        # Tables of the last state stay for readers that have them open.
        wanted = {x["at"] for s in (before, state) for kind in ("tables", "ended") for held in s[kind].values() for x in held}
        store, path = index._hadoop()
        for folder in (f.getPath().getName() for f in store.listStatus(path)):
            if folder.startswith("snapshot-") or folder.startswith("commit-"):
                held = [f.getPath().getName() for f in store.listStatus(index._hadoop(folder)[1])]
                dead = [n for n in held if f"{folder}/{n}" not in wanted]
                for n in dead if len(dead) < len(held) else [""]:
                    store.delete(index._hadoop(f"{folder}/{n}" if n else folder)[1], True)

    def _merge(self, state: dict) -> None:
        """Merge a table's last segments where ``FAN`` of them or more are each less than twice as large as what follows, and its files of ended owners."""
        for table, segments in state["tables"].items():
            if table == "blocks":  # they go with the postings
                continue
            first = len(segments)
            tail = 0
            for i in range(len(segments) - 1, -1, -1):
                if i < len(segments) - 1 and segments[i]["bytes"] < 2 * tail:
                    first = i
                tail += segments[i]["bytes"]
            if len(segments) - first >= FAN:
                self.small = tail_bytes(segments[first:]) < SMALL
                n = segments[-1]["n"]
                rows = self.index.live(table, state, segments[first:])
                if table == "terms":
                    rows = rows.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
                if table == "totals":
                    rows = rows.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                if table == "postings":
                    rows = bm25.ordered(rows.drop("block"), self.small)
                merged, live = self._write(f"merged-{table}", table, rows, n)
                state["tables"][table] = [*segments[:first], merged]
                if table == "postings":
                    kept = {s["n"] for s in segments[:first]}
                    bounds, _ = self._write("merged-blocks", "blocks", bm25.block_bounds(live), n)
                    state["tables"]["blocks"] = [s for s in state["tables"]["blocks"] if s["n"] in kept] + [bounds]
            held = state["tables"][table]
            ended = [e for e in state["ended"][table] if held and e["n"] > min(s["n"] for s in held)]
            if len(ended) > ENDED_FILES:
                at = f"{self.folder}/merged-ended-{table}"
                rows = self.index.spark.read.schema(ENDED).parquet(*[f"{self.index.uri}/{e['at']}" for e in ended])
                rows.groupBy("via", "owner").agg(F.max("segment").alias("segment")).select("via", "owner", "segment").write.parquet(f"{self.index.uri}/{at}")
                ended = [{"at": at, "n": max(e["n"] for e in ended)}]
            state["ended"][table] = ended
