"""Enrichment by an external model: prompts, replies, and the order of roll-ups.

The model is any callable from a prompt to a reply.  Prompts are built set by set in
Spark; calls run on executors, some at a time in each task.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.functions.columns import col, depth
from lodegrid.operators import edges as edge_ops
from lodegrid.operators import rollup

Model = Callable[[str], str]
CONCURRENCY, ATTEMPTS, CHILDREN_OF_FILE = 10, 3, 50
#: Replies of a file of the ledger, and tasks that share the calls at a time.
EVERY, TASKS = 10, 8
README_CHARS, SUMMARY_CHARS, PROMPT_DIRECTORIES = 3000, 100, 50
# Keys of the model's replies.
NODE_KEYS = ("semantic_summary", "domain_tags", "inferred_responsibility")
DIRECTORY_KEYS = ("summary", "domain_tags", "responsibility")


def unenriched(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("enriched_at").isNull())


def minutes(nodes: int, concurrency: int = CONCURRENCY) -> int:
    """Minutes that enrichment takes at a call a second for each of the concurrent callers."""
    return -(-nodes // (60 * concurrency))


def _kin(nodes: DataFrame) -> DataFrame:
    """(id, parent, children) as a prompt shows them."""
    kin = edge_ops.kinship(nodes).select("id", F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit(" — "), F.coalesce("parent_signature", F.lit("none")))).otherwise("none").alias("parent"))
    return kin.join(edge_ops.children(nodes), "id", "left").select("id", "parent", _shown("children").alias("children"))


def _shown(names: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, children, callers, callees) as a prompt shows them, for all nodes at once."""
    return _kin(nodes).join(edge_ops.neighbours(edges, nodes), "id", "left").select("id", "parent", "children", _shown("callers").alias("callers"), _shown("callees").alias("callees"))


def _node_prompt() -> Column:
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c, F.lit("\n"))
    return F.concat(
        F.lit("Describe this unit of code.\n"), line("Kind", F.col("node_type")), line("Name", F.col("qualified_name")), line("Signature", shown("signature")), line("Documentation", shown("docstring")),
        line("Belongs to", F.col("parent")), line("Contains", F.col("children")), line("Called by", F.col("callers")), line("Calls", F.col("callees")), F.lit("Source:\n"), shown("raw_source"),
        F.lit(f"\nReply with a JSON object alone, keys {', '.join(NODE_KEYS)}; domain_tags is an array of strings."),
    )


def _units(nodes: DataFrame) -> DataFrame:
    return unenriched(nodes).where(F.col("node_type") != "file")


def node_prompts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, prompt) for nodes to enrich; files come later, by roll-up."""
    return _units(nodes).join(context(nodes, edges), "id").select("id", _node_prompt().alias("prompt"))


def prompt_sizes(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, n_chars): the characters of each of ``node_prompts``, lists of callers and callees counted, not written.

    All lists together have as many names as there are calls, which grow with the square of a name's frequency; this grows with the corpus.
    """
    listed = lambda c: F.lit(2) + F.col(f"{c}_chars") + 2 * F.col(f"n_{c}") + 2 * F.greatest(F.col(f"n_{c}") - 1, F.lit(0))
    near = _kin(nodes).join(edge_ops.neighbour_sizes(nodes, lines), "id", "left").withColumns({"callers": F.lit(""), "callees": F.lit("")})
    return _units(nodes).join(near, "id").select("id", (F.length(_node_prompt()) + listed("callers") + listed("callees")).cast("bigint").alias("n_chars"))


def file_prompts(nodes: DataFrame) -> DataFrame:
    """(id, prompt) for files not yet enriched: their first enriched units, in order."""
    units = nodes.where((F.col("node_type") != "file") & F.col("enriched_at").isNotNull())
    first = units.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("ord"))).where(F.col("n") <= CHILDREN_OF_FILE)
    line = F.concat("node_type", F.lit(" "), "qualified_name", F.lit(": "), F.coalesce("semantic_summary", F.lit("")))
    told = first.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("told"))
    files = unenriched(nodes).where(F.col("node_type") == "file").join(told, "file_path")
    return files.select("id", F.concat(F.lit("Summarise this source file.\nFile: "), "file_path", F.lit("\n"), "told", F.lit(f"\nReply with a JSON object alone, keys {', '.join(DIRECTORY_KEYS)}.")).alias("prompt"))


def directory_prompts(contents: DataFrame) -> DataFrame:
    """(dir_path, prompt, child_count) from gathered contents."""
    whole = F.when(F.col("dir_path") == ".", F.lit("Summarise this project.\n")).otherwise(F.concat(F.lit("Summarise this directory.\nDirectory: "), "dir_path", F.lit("\n")))
    return contents.select("dir_path", F.concat(whole, "contents", F.lit(f"\nReply with a JSON object alone, keys {', '.join(DIRECTORY_KEYS)}.")).alias("prompt"), "child_count")


def system_prompt(readme: str | None, project: str | None, directories: list[tuple[str, str]]) -> str:
    """What a model should know of the project: README, summary, directories with shortened summaries."""
    parts = ["You document source code. Reply in JSON."]
    if readme:
        parts.append("README:\n" + readme[:README_CHARS])
    if project:
        parts.append("Project: " + project)
    if directories:
        short = lambda s: s if len(s) <= SUMMARY_CHARS else s[:SUMMARY_CHARS] + "..."
        parts.append("Directories:\n" + "\n".join(f"- {p}: {short(s or '')}" for p, s in directories[:PROMPT_DIRECTORIES]))
    return "\n\n".join(parts)


def informed(model: Model, system: str) -> Model:
    """A model that is told of the project before each prompt."""
    return lambda prompt: model(f"{system}\n\n{prompt}")


def project_prompt(summaries: DataFrame, readme: str | None) -> str:
    """The system prompt of an index: at most ``PROMPT_DIRECTORIES`` directories are fetched."""
    own = summaries.where("dir_path = '.'").select("summary").first()
    rows = summaries.where("dir_path <> '.'").select("dir_path", "summary").orderBy("dir_path").limit(PROMPT_DIRECTORIES).collect()
    return system_prompt(readme, own["summary"] if own else None, [(r["dir_path"], r["summary"]) for r in rows])


def parse_reply(reply: Column | str, keys: tuple[str, str, str] = NODE_KEYS) -> Column:
    """The reply's object as a struct, fences removed; null unless all keys are there and the tags are an array."""
    bare = F.regexp_replace(F.trim(col(reply)), r"^```[a-z]*\s*|\s*```$", "")
    kinds = [f"{keys[0]} string", f"{keys[1]} array<string>", f"{keys[2]} string"]
    found = F.from_json(bare, ", ".join(kinds))
    whole = F.get_json_object(bare, f"$.{keys[1]}").startswith("[")
    return F.when(found[keys[0]].isNotNull() & found[keys[1]].isNotNull() & found[keys[2]].isNotNull() & whole, found)


def safe_error(error: BaseException) -> str:
    """An error's text without anything that looks like a key."""
    return re.sub(r"(?i)(sk-|key[-_=: ]+|bearer\s+)[A-Za-z0-9_\-.]{6,}", r"\1***", str(error))


def call(model: Model, prompt: str, attempts: int = ATTEMPTS, wait: float = 1.0, retry: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)) -> str | None:
    """A reply, tried again after growing waits; None if it fails."""
    for n in range(attempts):
        try:
            return model(prompt)
        except retry:
            if n < attempts - 1:
                time.sleep(wait * 2**n)
        except Exception:  # noqa: BLE001 - one prompt's failure leaves the others
            return None
    return None


def replies(prompts: DataFrame, model: Model, key: str = "id", concurrency: int = CONCURRENCY) -> DataFrame:
    """(key, reply) for prompts (key, prompt), ``concurrency`` calls at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame({key: batch[key], "reply": list(pool.map(lambda p: call(model, p), batch["prompt"]))})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} string, reply string")


def replies_once(prompts: DataFrame, model: Model, ledger: str, key: str = "id", concurrency: int = CONCURRENCY, every: int = EVERY) -> DataFrame:
    """``replies``, each distinct prompt asked once, whatever fails or is evaluated again.

    Replies go to the ledger (the URI of a shared folder) as they come, ``every`` at a time, by the prompt's
    hash; a task that is run again reads its own, a later run all.  No reply is written for calls that failed, so these
    are tried again.  A task that dies loses what it hasn't written: fewer than ``every`` replies.
    ``concurrency`` bounds the calls at a time of all tasks together.
    """
    spark, run_id = prompts.sparkSession, uuid.uuid4().hex
    tasks = max(1, min(concurrency, TASKS))
    threads = max(1, concurrency // tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Ledger(f"{ledger}/{run_id}/{TaskContext.get().partitionId():05d}")
        known = own.read()
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, len(batch), every):
                    some = batch.iloc[at : at + every]
                    left = some[~some["hash"].isin(known)]
                    new = {h: r for h, r in zip(left["hash"], pool.map(lambda p: call(model, p), left["prompt"]), strict=True) if r is not None}
                    own.add(new)
                    known |= new
                    yield pd.DataFrame({"hash": some["hash"], "reply": [known.get(h) for h in some["hash"]]})

    held = _Ledger(ledger)
    held.open()
    done = spark.read.schema("hash string, reply string").option("recursiveFileLookup", "true").json(ledger).groupBy("hash").agg(F.max("reply").alias("reply"))
    asked = prompts.select(key, "prompt", F.sha2("prompt", 256).alias("hash"))
    distinct = asked.groupBy("hash").agg(F.max("prompt").alias("prompt"))
    new = distinct.join(done, "hash", "left_anti").repartition(tasks, "hash").select("hash", "prompt").mapInPandas(run, "hash string, reply string")
    return asked.select(key, "hash").join(done.unionByName(new), "hash", "left").select(key, "reply")


class _Ledger:
    """Files of replies in a folder of the shared store, each there under its name once it is whole."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, self.at = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)

    def open(self) -> None:
        self.store.create_dir(self.at, recursive=True)

    def read(self) -> dict[str, str]:
        from pyarrow import fs

        found = {}
        for info in self.store.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if info.path.endswith(".json"):
                with self.store.open_input_file(info.path) as f:
                    found |= {r["hash"]: r["reply"] for r in map(json.loads, f.read().decode().splitlines())}
        return found

    def add(self, replies: dict[str, str]) -> None:
        if replies:
            self.open()
            at = f"{self.at}/{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{at}.part") as f:
                f.write("".join(json.dumps({"hash": h, "reply": r}) + "\n" for h, r in replies.items()).encode())
            self.store.move(f"{at}.part", f"{at}.json")


def answered_nodes(nodes: DataFrame, answered: DataFrame, model_name: str, keys: tuple[str, str, str] = NODE_KEYS) -> DataFrame:
    """Only the nodes that have a good reply (id, reply), with it: what ``Index.enriched`` takes."""
    good = answered.select("id", parse_reply("reply", keys).alias("r")).where(F.col("r").isNotNull())
    new = {
        "semantic_summary": F.col("r")[keys[0]], "domain_tags": F.col("r")[keys[1]], "inferred_responsibility": F.col("r")[keys[2]],
        "enriched_at": F.current_timestamp(), "enrichment_model": F.lit(model_name),
    }
    return nodes.join(good, "id").select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns])


def apply_nodes(nodes: DataFrame, answered: DataFrame, model_name: str, keys: tuple[str, str, str] = NODE_KEYS) -> DataFrame:
    """Nodes with the parsed replies (id, reply); those without a good one stay as they are."""
    good = answered.select("id", parse_reply("reply", keys).alias("r")).where(F.col("r").isNotNull())
    joined = nodes.join(good, "id", "left")
    hit = F.col("r").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    changed = {
        "semantic_summary": F.col("r")[keys[0]], "domain_tags": F.col("r")[keys[1]], "inferred_responsibility": F.col("r")[keys[2]],
        "enriched_at": F.current_timestamp(), "enrichment_model": F.lit(model_name),
    }
    return joined.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in nodes.columns])


def enrich_nodes(nodes: DataFrame, edges: DataFrame, model: Model, model_name: str = "model", concurrency: int = CONCURRENCY) -> DataFrame:
    return apply_nodes(nodes, replies(node_prompts(nodes, edges), model, concurrency=concurrency), model_name)


def enrich_files(nodes: DataFrame, model: Model, model_name: str = "model", concurrency: int = CONCURRENCY) -> DataFrame:
    return apply_nodes(nodes, replies(file_prompts(nodes), model, concurrency=concurrency), model_name, DIRECTORY_KEYS)


def enrich_directories(nodes: DataFrame, summaries: DataFrame, model: Model, model_name: str = "model", write: Callable[[DataFrame], DataFrame] = lambda df: df.cache(), concurrency: int = CONCURRENCY, ledger: str | None = None, most: int | None = None) -> DataFrame:
    """Directory summaries, the deepest first, as each level reads the one below; the project is last.

    ``write`` stores a level before the next one reads it.  With ``most``, a prompt lists that many children and counts the rest.
    """
    dirs = rollup.directories(nodes.where(F.col("node_type") == "file"), "file_path")
    stale = write(rollup.stale_directories(dirs, nodes, summaries))
    deepest = dirs.agg(F.max("depth")).first()[0]
    for level in range(deepest if deepest is not None else -2, -2, -1):
        now = stale.where(depth("dir_path") == level)
        if now.isEmpty():
            continue
        asked = directory_prompts(rollup.contents(nodes, summaries, now, most))
        told = replies_once(asked, model, ledger, "dir_path", concurrency) if ledger else replies(asked, model, "dir_path", concurrency)
        good = told.select("dir_path", parse_reply("reply", DIRECTORY_KEYS).alias("r")).where(F.col("r").isNotNull())
        new = good.join(asked.select("dir_path", "child_count"), "dir_path").select(
            "dir_path", "r.summary", "r.domain_tags", "r.responsibility", "child_count", F.current_timestamp().alias("enriched_at"), F.lit(model_name).alias("enrichment_model")
        )
        summaries = write(summaries.join(new.select("dir_path"), "dir_path", "left_anti").unionByName(new))
    return summaries


