"""Questions over retrieved mail: context, citations, gates, the model ladder."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridmail.functions.text import RECENCY_TERMS, clip, relative_age

# Fixed values that results depend on.
LADDER = (("qwen3.6:35b-mlx", 28.0, True), ("gpt-oss:20b", 16.0, True), ("qwen3:8b", 7.6, True), ("granite4.1:3b", 3.0, False))
RESERVED_GB = 2.0 + 5.0
SENDER, SUBJECT, EXCERPT = 120, 200, 800
NOT_FOUND = "Nothing in the mail answers this question."
INSTRUCTIONS = (
    "You answer from mail. What isn't in the excerpts you don't know: say so instead of guessing. "
    "After each statement put the source's number in brackets, like [3]. "
    "Excerpts carry a date and how long ago that was. If somebody wants to know what is recent or ahead, go from the latest excerpt back, write the dates, and call nothing new that is months old."
)


@dataclass(frozen=True)
class Options:
    """How a generator is to answer: fixed values unless given."""

    temperature: float = 0.2
    keep_alive: str = "30m"
    stream: bool = True


def asks_for_recent(question: str) -> bool:
    return any(t in question.lower() for t in RECENCY_TERMS)


def ordered(hits: DataFrame, question: str) -> DataFrame:
    """Hits (relevance_rank, received_at) with n, the number to cite: newest first for questions about recency, else by relevance."""
    order = ([F.desc_nulls_last("received_at")] if asks_for_recent(question) else []) + [F.asc("relevance_rank")]
    return hits.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def context_block(now: Column) -> Column:
    """One numbered source, from n, sender, subject, received_at, body_preview, snippet."""
    excerpt = F.when(F.coalesce(F.col("body_preview"), F.lit("")) == "", F.coalesce("snippet", F.lit(""))).otherwise(F.col("body_preview"))
    date = F.coalesce(F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))
    head = lambda c, n: clip(F.coalesce(c, F.lit("")), n)
    return F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] From: "), head(F.col("sender"), SENDER), F.lit("\n    Subject: "), head(F.col("subject"), SUBJECT), F.lit("\n    Date: "), date, relative_age(F.col("received_at"), now), F.lit("\n    Excerpt: "), clip(excerpt, EXCERPT), F.lit("\n"))


def context(hits: DataFrame, now: Column) -> DataFrame:
    """One row: all blocks in the order of n."""
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", context_block(now).alias("block")))), lambda x: x["block"]), "\n").alias("context"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: answer_id, answer; sources: answer_id, n and more. With cited (its number stands in the answer) and shown (cited, or no source is)."""
    marks = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1)))).alias("mark")).select("answer_id", F.col("mark").cast("int").alias("n")).distinct()
    rows = sources.join(marks.withColumn("_c", F.lit(True)), ["answer_id", "n"], "left").withColumn("cited", F.col("_c").isNotNull()).drop("_c")
    any_cited = F.max("cited").over(Window.partitionBy("answer_id"))
    return rows.withColumn("shown", F.col("cited") | ~any_cited)


def installed_as(installed: Column, wanted: Column) -> Column:
    """Whether a tag is there, exactly or with a suffix after a hyphen."""
    return F.exists(installed, lambda t: (t == wanted) | t.startswith(F.concat(wanted, F.lit("-"))))


def present_as(installed: Column, wanted: Column) -> Column:
    """The laxer test by the name before the colon."""
    base = F.substring_index(wanted, ":", 1)
    return F.exists(installed, lambda t: (t == wanted) | (t == base) | t.startswith(F.concat(base, F.lit(":"))))


def budget_gb(total: Column) -> Column:
    return F.greatest(total - RESERVED_GB, F.lit(0.0))


def auto_pick(machines: DataFrame) -> DataFrame:
    """machines: machine, ram_gb, installed. With state (model, needs_pull, search_only) and pick: the first rung of the ladder that fits and is installed, else the first that fits."""
    b = budget_gb(F.col("ram_gb"))
    fits = [(F.lit(m), F.lit(gb) <= b) for m, gb, auto in LADDER if auto]
    there = F.coalesce(*[F.when(ok & installed_as(F.col("installed"), m), m) for m, ok in fits])
    wanted = F.coalesce(*[F.when(ok, m) for m, ok in fits])
    return machines.withColumns({"state": F.when(there.isNotNull(), "model").when(wanted.isNotNull(), "needs_pull").otherwise("search_only"), "pick": F.coalesce(there, wanted)})


def list_models(machines: DataFrame, embedder: str) -> DataFrame:
    """A row for each machine (machine, ram_gb, installed, current) and rung or other installed model but the embedder."""
    rungs = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(m).alias("model"), F.lit(gb).alias("needs_gb")) for i, (m, gb, _) in enumerate(LADDER)])
    named = machines.select("*", F.explode(rungs).alias("r")).select("machine", "r.rung", "r.model", installed_as(F.col("installed"), F.col("r.model")).alias("installed"), (F.col("r.needs_gb") <= budget_gb(F.col("ram_gb"))).alias("fits"), (F.col("r.model") == F.col("current")).alias("is_current"))
    ladder = [m for m, _, _ in LADDER]
    other = F.filter(F.col("installed"), lambda t: ~F.exists(F.array(*map(F.lit, ladder)), lambda m: (t == m) | t.startswith(F.concat(m, F.lit("-")))) & ~((t == embedder) | t.startswith(f"{embedder}:")))
    rest = machines.select("*", F.explode(other).alias("model")).select("machine", F.lit(None).cast("int").alias("rung"), "model", F.lit(True).alias("installed"), F.lit(None).cast("boolean").alias("fits"), (F.col("model") == F.col("current")).alias("is_current"))
    return named.unionByName(rest)


def ask_gate(reachable: Column, state: Column, source: Column, current_installed: Column) -> Column:
    """Why asking is off: server_down, too_small, not_installed; or open."""
    return F.when(~reachable, "server_down").when((state == "search_only") & ~source.eqNullSafe(F.lit("user")), "too_small").when(~current_installed, "not_installed").otherwise("open")


_BULLET, _NUMBER, _HEADING = re.compile(r"\s*[-*•]\s+(.*)"), re.compile(r"\s*\d+[.)]\s+(.*)"), re.compile(r"\s*#{1,6}\s+(.*)")


def blocks(answer: str) -> list[tuple[str, list[str]]]:
    """Paragraphs, headings and lists of an answer, in order."""
    out: list[tuple[str, list[str]]] = []
    for line in answer.split("\n"):
        for kind, pattern in (("heading", _HEADING), ("bullets", _BULLET), ("numbers", _NUMBER)):
            if m := pattern.match(line):
                if kind != "heading" and out and out[-1][0] == kind:
                    out[-1][1].append(m[1])
                else:
                    out.append((kind, [m[1]]))
                break
        else:
            if not line.strip():
                out.append(("", []))
            elif out and out[-1][0] == "paragraph":
                out[-1][1].append(line.strip())
            else:
                out.append(("paragraph", [line.strip()]))
    return [x for x in out if x[0]]


@dataclass(frozen=True)
class Answer:
    question: str
    answer: str
    model: str | None
    citations: list[dict]
