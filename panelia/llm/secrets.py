"""Secret scans, with DataFrame functions only.

Base rules (``assign``, ``access``, ``hex``) find spans by pattern.  The method finds further ones: a candidate
string is scored by two first-order character Markov models, one of random strings and one of ordinary
identifiers, and is a secret where the mean log-likelihood ratio of its transitions exceeds ``THRESHOLD``.
Both models are trained from labelled samples: generated random strings in several alphabets (label 1), and
words and compound identifiers out of a bounded sample of documents (label 0).  A model is one table of
len(ALPHABET)**2 numbers, a literal of the plan; nothing is shuffled while texts are scanned.

Positions are code points, ends are exclusive.  Defined cases: a null text is empty and has no span; spans of a
very long text are sorted, not compared with each other; repeated
rows are scanned one by one; columns besides doc_id and text are left alone; without documents the ordinary
model is the uniform one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pack, unpack

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: A whole run of these characters, 20 or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.5
SAMPLE_DOCUMENTS, SAMPLE_RANDOM = 400, 3000
BLOCK = 1000
MARK = "[SECRET]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(steps: Column, join: Callable[[Column, Column], Column] = lambda s, x: s + x) -> Column:
    """Running sums (or what else joins, from 0) of an array of longs, by blocks, since appending copies."""

    def block(values: Column, b: Column) -> Column:
        base = F.aggregate(F.slice(values, 1, b * BLOCK), F.lit(0).cast("long"), join)
        grown = F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), F.array(base), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x))))
        return F.slice(grown, 2, F.lit(BLOCK))

    return let(steps, lambda v: F.when(F.size(v) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: block(v, b)))).otherwise(F.array().cast("array<long>")))


def spans(text: Column, pattern: str, kind: str, ok: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """The pattern's matches, leftmost and non-overlapping, as structs (start, kind, end, body); kind by its number.

    The lengths of the pieces between the matches and of the matches add up to the positions.
    """
    number = KINDS.index(kind)
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    body = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), body.alias("body"))
    parts = F.filter(parts, lambda x: x["hit"].isNotNull())

    def place(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")))
        return F.zip_with(z, ends, lambda x, e: F.struct((e - F.length(x["hit"])).alias("start"), F.lit(number).alias("kind"), e.alias("end"), x["body"].alias("body")))

    found = let(parts, place)
    if ok:
        found = F.filter(found, lambda x: ok(x["body"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start: bigint, kind: int, end: bigint, body: string>>"))


def transitions(samples: DataFrame) -> DataFrame:
    """(label, n) by pair of ALPHABET's characters, from rows (sample, label)."""
    chars = samples.select("label", F.split("sample", "").alias("c"))
    pairs = chars.select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    return pairs.groupBy("label", "pair").agg(F.count("*").alias("n"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(sample, label): random strings (1), words and identifiers of SAMPLE_DOCUMENTS documents (0)."""
    spark = docs.sparkSession
    seed = F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 512)
    raw = F.base64(F.unhex(seed))
    kinds = F.array(F.substr(seed, F.lit(1), F.lit(40)), F.substr(raw, F.lit(1), F.lit(40)), F.upper(F.regexp_replace(raw, "[^A-Za-z2-7]", "")), F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    random = spark.range(0, SAMPLE_RANDOM, numPartitions=1).select(F.explode(kinds).alias("sample"), F.lit(1).alias("label"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    # broadcast: at most SAMPLE_DOCUMENTS ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null")
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) >= 2)
    following = F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0)))
    glued = F.zip_with("w", following, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), F.pmod(F.hash(a, b), F.lit(4)) + 1), F.when(F.pmod(F.hash(b), F.lit(2)) == 0, F.initcap(b)).otherwise(b))).otherwise(F.upper(a)))
    ordinary = texts.select(words.alias("w")).where(F.size("w") > 0).select(F.explode(F.concat("w", glued)).alias("sample"), F.lit(0).alias("label"))
    return random.unionByName(ordinary)


def train(docs: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random to ordinary) of the transitions, row by row of ALPHABET."""
    n = len(ALPHABET)
    counts = [[[smoothing] * n for _ in range(n)] for _ in range(2)]
    # at most 2 * len(ALPHABET)**2 rows
    for row in transitions(labelled_samples(docs)).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[row["label"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["n"]
    log = [[[math.log(x / sum(line)) for x in line] for line in table] for table in counts]
    return [log[1][i][j] - log[0][i][j] for i in range(n) for j in range(n)]


def ratio(body: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a string's transitions."""
    n = len(ALPHABET)
    places = F.transform(F.split(body, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    total = let(places, lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(a, i - 1) * n + F.get(a, i))))
    return total / (F.length(body) - 1)


def render(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs`` with sorted arrays ``_base`` and ``_all`` of structs (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    base = F.concat(spans(text, ASSIGN, "assign", lambda b: F.length(b) >= 12, 2), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    likely = spans(text, CANDIDATE, "markov", lambda b: ratio(b, table) > THRESHOLD)
    found = docs.withColumn("_base", F.array_sort(F.transform(base, bare))).withColumn("_likely", F.transform(likely, bare))
    # by start, base spans first: a likely one lies in a base span if one that has begun ends no earlier
    known = KINDS.index("markov")
    every = F.array_sort(F.concat("_base", "_likely"))
    reach = lambda z: running(F.transform(z, lambda x: F.when(x["kind"] < known, x["end"]).otherwise(F.lit(0).cast("long"))), lambda s, x: F.greatest(s, x))
    marked = let(every, lambda z: F.zip_with(z, reach(z), lambda x, r: F.struct(x.alias("x"), ((x["kind"] < known) | (r < x["end"])).alias("stays"))))
    kept = F.transform(F.filter(marked, lambda y: y["stays"]), lambda y: y["x"])
    return found.withColumn("_all", F.when(F.size("_likely") > 0, kept).otherwise(F.col("_base"))).drop("_likely")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and spans of every document."""
    found = find(docs.select("doc_id", "text"), train(docs))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(render(F.col("_base")), 256).alias("base_sha256"), render(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by MARK, and n_chars to match."""
    needed = ("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    found = find(pack(docs, *needed), train(docs.select("doc_id", "text")))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    # spans come by start: one that begins before the last end extends it
    merged = F.aggregate(
        "_all",
        empty,
        lambda s, x: F.when(
            (F.size(s) > 0) & (x["start"] < F.element_at(s, -1)["end"]),
            F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["start"].alias("start"), F.greatest(F.element_at(s, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(s, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    cut = found.withColumn("_cut", F.when(F.size("_all") > 0, merged).otherwise(empty))
    pieces = F.transform("_cut", lambda x, i: F.concat(F.substr("text", F.when(i > 0, F.get("_cut", i - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1, (x["start"] - F.when(i > 0, F.get("_cut", i - 1)["end"]).otherwise(F.lit(0))).cast("int")), F.lit(MARK)))
    text = F.when(F.size("_cut") > 0, F.concat(F.array_join(pieces, ""), F.substr(F.col("text"), F.element_at("_cut", -1)["end"].cast("int") + 1, F.length("text")))).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return unpack(out, docs.columns, needed)
