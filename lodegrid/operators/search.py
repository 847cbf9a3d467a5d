"""The search strategies, each a lazy DataFrame of ranked nodes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.functions import query_text
from lodegrid.functions.columns import word_count
from lodegrid.operators import bm25, graph, rollup
from lodegrid.operators.resolve import innermost, matching

RESULT = ("id", "file_path", "node_type", "name", "qualified_name", "signature", "semantic_summary", "domain_tags", "start_line", "end_line")
MAX_DIRECTORIES, SOURCE_DIRECTORIES = 5, 3


def present(ranked: DataFrame, nodes: DataFrame, with_source: bool = False) -> DataFrame:
    """Result columns of ranked ids (id, rank, score), in order; sources only on demand."""
    raw = (F.col("raw_source") if with_source else F.lit(None).cast("string")).alias("raw_source")
    return nodes.join(F.broadcast(ranked), "id").select(*RESULT, raw, "rank", "score").orderBy("rank")


def score_lexical(hits: DataFrame, identifier: str, files: int) -> DataFrame:
    """Scores of nodes (id, name, hits, ...) by exact name, hits, and how rare and telling the identifier is."""
    whole = F.col("whole_matches")
    rarity = F.greatest(F.ln(F.lit(float(max(files, 1))) / (1 + F.col("whole_files"))), F.lit(0.1))
    common = 0.5 if identifier.lower() in query_text.COMMON else 1.0
    exact = F.when(F.col("name") == identifier, 10.0).otherwise(0.0)
    return hits.withColumn("score", (exact + 1.0 / whole + 0.5 * F.col("hits")) * rarity * common)


def lexical(identifier: str, nodes: DataFrame, lines: DataFrame, k: int = 10, files: int | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(id, rank, score): nodes whose lines have an identifier as a whole word.

    ``mentions``: stored words of lines with their nodes, where the identifier's longest word is looked up; only if it has
    more characters than that word its lines are read and matched.  Without them all lines are.
    """
    word = max(re.findall(r"\w+", identifier), key=len, default="")
    if mentions is not None and word:
        found = mentions.where(F.col("word") == word).select("file_path", "line_no", "node_id")
        if word != identifier:
            text = matching(lines, "file_path", found.select("file_path")).where(word_count("text", identifier) > 0).select("file_path", "line_no")
            found = found.join(text, ["file_path", "line_no"], "left_semi")
        named = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("file_path").alias("node_file_path"), F.col("start_line").alias("node_start_line"))
        near = found.join(named, "node_id")
    else:
        found = lines.where(F.col("text").contains(identifier)).where(word_count("text", identifier) > 0).select("file_path", "line_no")
        near = innermost(found, nodes, ["id", "name", "file_path", "start_line"])
    whole = found.agg(F.count(F.lit(1)).alias("whole_matches"), F.countDistinct("file_path").alias("whole_files"))
    if files is None:
        files = nodes.agg(F.countDistinct("file_path")).first()[0]
    hits = near.groupBy(F.col("node_id").alias("id"), F.col("node_name").alias("name"), F.col("node_file_path").alias("path"), F.col("node_start_line").alias("start")).agg(F.count(F.lit(1)).alias("hits"))
    scored = score_lexical(hits.crossJoin(F.broadcast(whole)), identifier, files)  # whole is one row
    order = [F.col("score").desc(), F.col("path"), F.col("start"), F.col("id")]
    best = scored.orderBy(*order).limit(k)
    return best.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), "score")


def semantic(text: str, nodes: DataFrame, k: int = 10, index: DataFrame | bm25.Stored | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(id, rank, score): full-text search, nodes with all terms before those with any.

    ``index``: the stored index of the nodes, of which only the query's terms are read; or postings, with ``sizes``.
    """
    if isinstance(index, bm25.Stored):
        return bm25.top(index, query_text.phrases(text), None, k).select("id", "rank", "score")
    if index is None:
        index = bm25.Unindexed(nodes)
    elif sizes is None:
        sizes = bm25.text_lengths(nodes)
    return bm25.top(index, query_text.phrases(text), nodes.select("id"), k, sizes).select("id", "rank", "score")


def semantic_directories(text: str, summaries: DataFrame, k: int = 10) -> DataFrame:
    """(dir_path, rank, score): the directory leg of full-text search, over their summaries."""
    index = bm25.Unindexed(summaries, bm25.DIRECTORY_TEXTS, "dir_path")
    return bm25.top(index, query_text.phrases(text), summaries.select("dir_path"), k).select(F.col("id").alias("dir_path"), "rank", "score")


def first_wins(legs: list[DataFrame], k: int) -> DataFrame:
    """Ranked legs one after another, each id where it comes first; the first ``k``."""
    rows = reduce(DataFrame.unionByName, [leg.select("id", F.lit(n).alias("leg"), F.col("rank").alias("place"), "score") for n, leg in enumerate(legs)])
    once = rows.groupBy("id").agg(F.min(F.struct("leg", "place", "score")).alias("at"))
    best = once.select("id", "at.leg", "at.place", "at.score").orderBy("leg", "place", "id").limit(k)
    return best.select("id", F.row_number().over(Window.orderBy("leg", "place", "id")).alias("rank"), "score")


def hybrid(text: str, nodes: DataFrame, lines: DataFrame, k: int = 10, index: DataFrame | bm25.Stored | None = None, sizes: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Lexical search for each identifier of the query, in order, then full-text search."""
    words = [w for w in dict.fromkeys(text.split()) if query_text.is_identifier(w)]
    files = nodes.agg(F.countDistinct("file_path")).first()[0] if words else 0
    return first_wins([lexical(w, nodes, lines, k, files, mentions) for w in words] + [semantic(text, nodes, k, index, sizes)], k)


def describe(ranked: DataFrame, summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranked directories (dir_path, rank) with their summaries, children and counts."""
    kids = rollup.child_directories(summaries.select("dir_path"))
    empty = F.array().cast("array<string>")
    out = F.broadcast(ranked).join(summaries, "dir_path").join(kids, "dir_path", "left").join(rollup.counts(nodes), "dir_path", "left")
    return out.select(
        "dir_path", "summary", F.coalesce("domain_tags", empty).alias("domain_tags"), "responsibility", F.coalesce("child_dirs", empty).alias("child_dirs"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("node_count", F.lit(0)).alias("node_count"), "rank",
    ).orderBy("rank")


def project_summary(summaries: DataFrame) -> str | None:
    row = summaries.where(F.col("dir_path") == ".").select("summary").first()
    return row["summary"] if row else None


def hierarchical(text: str, nodes: DataFrame, summaries: DataFrame, k: int = 10) -> dict:
    """Project summary, the directories that match best, and nodes below the first of them."""
    ranked = semantic_directories(text, summaries, MAX_DIRECTORIES).select("dir_path", "rank")
    wanted = ranked.where(F.col("rank") <= SOURCE_DIRECTORIES).select("dir_path", F.col("rank").alias("place"))
    near = rollup.listing(nodes, wanted, k).limit(k)
    return {"project_summary": project_summary(summaries), "directories": describe(ranked, summaries, nodes), "nodes": near.select(*RESULT)}


def parse_array(reply: str) -> list[str]:
    """The JSON array of strings in a model's reply: fenced, bare or amid prose; [] without one."""
    bare = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", reply or "")
    for part in (bare, *(m[0] for m in [re.search(r"\[.*\]", bare, re.DOTALL)] if m)):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, list):
            return [str(x) for x in found]
    return []


def hierarchical_llm(text: str, nodes: DataFrame, summaries: DataFrame, llm: Callable[[str], str], k: int = 10) -> dict:
    """As ``hierarchical``, a model choosing the directories and then ranking their files.

    Falls back to it where no directory is left of the model's choice or it fails; if only
    the ranking of files fails, directories come without nodes.
    """
    known = summaries.where(F.col("dir_path") != ".").select("dir_path", "summary").orderBy("dir_path").collect()  # a prompt's worth
    if not known:
        return hierarchical(text, nodes, summaries, k)
    try:
        listed = "\n".join(f"- {r['dir_path']}: {r['summary']}" for r in known)
        reply = llm(f"Query: {text}\n\nDirectories:\n{listed}\n\nReply with a JSON array of at most {MAX_DIRECTORIES} directory paths, the most relevant first.")
    except Exception:  # noqa: BLE001 - any client may be given
        return hierarchical(text, nodes, summaries, k)
    paths = {r["dir_path"] for r in known}
    chosen = [p for p in dict.fromkeys(parse_array(reply)) if p in paths][:MAX_DIRECTORIES]
    spark = nodes.sparkSession
    ranked = spark.createDataFrame([(p, i + 1) for i, p in enumerate(chosen)], "dir_path string, rank int")
    below = rollup.listing(nodes, ranked.select("dir_path", F.col("rank").alias("place")), 50)
    rows = below.select("file_path", "node_type", "qualified_name", "semantic_summary").limit(50).collect() if chosen else []
    if not rows:
        return hierarchical(text, nodes, summaries, k)
    out = {"project_summary": project_summary(summaries), "directories": describe(ranked, summaries, nodes)}
    try:
        listed = "\n".join(f"- {r['file_path']}: {r['node_type']} {r['qualified_name']} {r['semantic_summary'] or ''}" for r in rows)
        files = parse_array(llm(f"Query: {text}\n\nFiles:\n{listed}\n\nReply with a JSON array of file paths, the most relevant first."))
    except Exception:  # noqa: BLE001
        files = []
    order = spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(files))], "file_path string, place int")
    found = nodes.join(F.broadcast(order), "file_path").orderBy("place", "start_line", "ord", "id").limit(k)
    return out | {"nodes": found.select(*RESULT)}


def run(text: str, tables: dict[str, DataFrame], kind: str | None = None, k: int = 10, depth: int = 2, with_source: bool = False, llm: Callable[[str], str] | None = None, index: bm25.Stored | None = None) -> tuple[str, object]:
    """Route a query, search, and fall back: lexical to full-text, full-text to the identifiers of the query.

    ``index``: the stored full-text index of the nodes.
    """
    nodes, lines, words = tables["nodes"], tables["lines"], tables.get("mentions")
    chosen = query_text.strategy(text, kind)
    if chosen == "graph":
        return chosen, graph.search(text, nodes, tables["edges"], depth)
    if chosen == "hierarchical-llm" and llm:
        return chosen, hierarchical_llm(text, nodes, tables["directories"], llm, k)
    if chosen.startswith("hierarchical"):
        return chosen, hierarchical(text, nodes, tables["directories"], k)
    if chosen == "hybrid":
        return chosen, present(hybrid(text, nodes, lines, k, index, mentions=words), nodes, with_source)
    # At most k rows: kept, as they are looked at and then shown.
    ranked = (lexical(text, nodes, lines, k, mentions=words) if chosen == "lexical" else semantic(text, nodes, k, index)).cache()
    if ranked.isEmpty():
        given = [w for w in text.split() if query_text.is_identifier(w)] or text.split()
        ranked = semantic(text, nodes, k, index) if chosen == "lexical" else first_wins([lexical(w, nodes, lines, k, mentions=words) for w in given], k) if given else ranked
    return chosen, present(ranked, nodes, with_source)
