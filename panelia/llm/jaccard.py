"""N-gram Jaccard join by partitioning the universe of shingles (pigeonhole), with exact verification.

A document's set holds the hashes of its distinct word shingles.  Sizes are cut into bands, so that linked sets
lie in one band or in neighbouring ones; a pair is looked for in the scheme of its larger set's band.  In a
scheme, shingles are hashed into m segments.  Two linked sets differ in at most H shingles, so that of any
H + 1 segments one is equal in both; a segment in which one shingle may be missing on either side (its
one-deletion neighbourhood) counts twice.  Every set chooses the cheapest allocation that its segments allow:

    level t >= 1   the segments of t or more shingles, if there are H + 1 of them (the greatest such t)
    level 0        the filled segments, those of two or more with their one-deletion neighbourhoods
    level -1       all segments, empty ones too, with one-deletion neighbourhoods

What a level emits holds what any higher level emits, and which segment a level takes depends on the segment
alone: hence the set of the higher level finds its common segment among those of the other.

Equal sets are one node (their documents are a class).  Sets with a common signature are candidates.  A bucket
sends pairs with its least node only (a bucket inside a slice of the input too, so that a large group of copies
sends one row per slice and signature).  Verified links make components; buckets that still hold several
components are compared again, with another pivot, and then across components, so that no link that joins
components is lost: in buckets of up to ``few`` members by all pairs (filtered by sizes and by parity sketches, lower
bounds of the difference), in larger ones by prefixes.  For those, a set's shingles are put in one order for all
sets, shingles of one component first, then rare ones; linked sets of n and m shingles have at least
o = num * (n + m) / (num + den) in common, so that their first common shingle is among the first n - o + 1 of one
and m - o + 1 of the other.  Sets meet by such a shingle and by their bands of sizes, and only across components;
sets that are alike but not linked have too many shingles of their own to meet.

Defined cases: a null text, or one without words, has no set and is linked with nothing; a text of fewer words
than the shingle has one shingle, all its words; repeated rows are in one component; a null doc_id takes
part but never names a component; other columns are ignored.  Hashes have 64 bits.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bitmap, maybe
from .components import components
from .shared import pack, stored, unpack
from .words import BASE, as_string, bound_batches, hash_words, mix, ngram_hashes, signed, slices, split_words, tidy

NODE_BITS = 25
SEGMENT_SALT, BAND_SALT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1B54A32D192ED03)
SKETCH = 4


@dataclass(frozen=True)
class Settings:
    """Link when den * intersection >= num * union; ``few`` None: buckets of any size are compared by all pairs."""

    words: int = 5
    num: int = 80
    den: int = 100
    slack: float = 1.12
    top_level: int = 8
    few: int | None = 16


def differ(total: int | np.ndarray, s: Settings):
    """The most shingles in which two linked sets of ``total`` shingles together differ."""
    return total * (s.den - s.num) // (s.den + s.num)


def band_starts(s: Settings, largest: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * s.den // s.num + 1)
    return np.array([*starts, starts[-1] * s.den // s.num + 1], np.int64)


def size_band(n: F.Column) -> F.Column:
    """Number of a band of sizes: sizes up to 32 by themselves, then 16 bands for each doubling."""
    e = F.greatest(F.length(F.bin(n)) - 5, F.lit(0))
    return 16 * e + F.call_function("shiftright", n, e)


def band_floor(b: F.Column) -> F.Column:
    """The smallest size of a band."""
    e = F.greatest((F.floor(b / 16) - 1).cast("int"), F.lit(0))
    return F.call_function("shiftleft", b - 16 * e, e)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of every text; by text, then by hash."""
    owner, words = split_words(pc.ascii_lower(as_string(texts)))
    hashes = hash_words(words)
    n = len(texts)
    at, grams = ngram_hashes(hashes, owner, k)
    of = owner[at]
    length = np.bincount(owner, minlength=n)
    begin = np.cumsum(length) - length
    short = np.flatnonzero((length > 0) & (length < k))
    whole = np.empty(len(short), np.uint64)
    for i, t in enumerate(short):
        whole[i] = xxhash.xxh3_64_intdigest(hashes[begin[t] : begin[t] + length[t]].tobytes(), 1)
    of, grams = np.concatenate([of, short.astype(of.dtype)]), np.concatenate([grams, whole])
    if len(short):
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    edges = np.searchsorted(of, np.arange(n + 1))
    parts = [np.unique(grams[edges[t] : edges[t + 1]]) for t in range(n)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.repeat(np.arange(n), sizes), np.concatenate(parts) if parts else grams


def node_ids(owner: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets and their ids (0 where empty)."""
    edges = np.searchsorted(owner, np.arange(n + 1))
    ids = np.array([xxhash.xxh3_64_intdigest(grams[a:b].tobytes()) if b > a else 0 for a, b in zip(edges[:-1], edges[1:], strict=True)], np.uint64)
    return np.diff(edges), ids


def signatures(owner: np.ndarray, grams: np.ndarray, sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Owner and signature, for both schemes of every set."""
    starts = band_starts(s, int(sizes.max(initial=1)))
    own = np.searchsorted(starts, sizes, side="right") - 1
    owners, found = [], []
    for ahead in (0, 1):
        band = own + ahead
        low, high = starts[band], starts[band + 1] - 1
        partner = np.minimum(high, sizes * s.den // s.num)
        h = np.where((sizes > 0) & (partner >= (low if ahead else 1)), differ(sizes + partner, s), 0)
        use = h > 0
        if not use.any():
            continue
        m = np.where(use, np.ceil((differ(2 * high, s) + 1) * s.slack).astype(np.int64), 0)
        base = np.cumsum(m) - m
        pick = use[owner]
        o, g = owner[pick], grams[pick]
        segment = base[o] + (mix(g ^ SEGMENT_SALT) % m[o].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums, count = np.zeros(total, np.uint64), np.bincount(segment, minlength=total)
        np.add.at(sums, segment, g)
        holder = np.repeat(np.arange(len(m)), m)
        number = np.arange(total) - np.repeat(base, m)
        level = np.full(len(m), -1)
        by = lambda mask: np.bincount(holder, mask, len(m))
        level[(by(count >= 2) + by(count >= 1) >= h + 1) & use] = 0
        for t in range(1, s.top_level + 1):
            level[(by(count >= t) >= h + 1) & use] = t
        with np.errstate(over="ignore"):
            label = mix(number.astype(np.uint64) * BASE + band[holder].astype(np.uint64) * BAND_SALT)
        least = np.where(level == -1, 0, np.maximum(level, 1))
        exact = np.flatnonzero(count >= least[holder])
        owners.append(holder[exact])
        found.append(mix(sums[exact] ^ label[exact]))
        loose = np.flatnonzero((level[o] <= 0) & (count[segment] >= np.where(level[o] == 0, 2, 1)))
        if len(loose):
            with np.errstate(over="ignore"):
                without = sums[segment[loose]] - g[loose]
            owners.append(o[loose])
            found.append(mix(without ^ label[segment[loose]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def sketches(owner: np.ndarray, grams: np.ndarray, n: int) -> list[np.ndarray]:
    """Parity bits of the hashes in SKETCH words: sets that differ in d shingles differ in at most d bits."""
    bits = np.bincount(owner * (64 * SKETCH) + (grams % np.uint64(64 * SKETCH)).astype(np.int64), minlength=n * 64 * SKETCH) & 1
    words = bits.reshape(n, SKETCH, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return list(np.bitwise_or.reduce(words, axis=2).view(np.int64).T)


class Join:
    """The stages of one join; tables that are used twice are written to the shared folder."""

    def __init__(self, docs: DataFrame, settings: Settings):
        self.s = settings
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
        self.kind = self.docs.schema["doc_id"].dataType.simpleString()
        bound_batches(docs.sparkSession, 8)
        self.spark = docs.sparkSession

    def rows(self) -> DataFrame:
        """(doc_id, key, n, node) of every row; node null where the set is empty."""
        k = self.s.words

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    n, ids = node_ids(*shingle_sets(part.column("text"), k), part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(signed(ids), mask=n == 0)], names=["doc_id", "key", "n", "node"])

        return stored(self.docs.mapInArrow(run, f"doc_id {self.kind}, key long, n long, node long"), "jaccard-rows", narrow=True)

    def candidates(self) -> DataFrame:
        """(sig, a, na, b, nb): b is the least node of a's bucket (or of its part in a slice), and not a."""
        s = self.s

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, limit=4 << 20):
                    owner, grams = shingle_sets(part.column("text"), s.words)
                    n, ids = node_ids(owner, grams, part.num_rows)
                    by_id, first = np.unique(ids, return_index=True)
                    distinct = np.zeros(part.num_rows, bool)
                    distinct[first[by_id > 0]] = True
                    keep = distinct[owner]
                    o, sig = signatures(owner[keep], grams[keep], np.where(distinct, n, 0), s)
                    node = ids[o].view(np.int64)
                    order = np.argsort(sig, kind="stable")
                    sig, o, node = sig[order], o[order], node[order]
                    new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
                    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(sig))))
                    least = np.minimum.reduceat(node, new) if len(new) else node
                    size_of = dict(zip(ids.view(np.int64).tolist(), n.tolist(), strict=True))
                    heads = pa.RecordBatch.from_arrays(
                        [pa.array(signed(sig[new])), pa.array(signed(sig[new])), pa.array(least), pa.array(np.array([size_of[x] for x in least.tolist()], np.int32)), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.int32())],
                        names=["at", "sig", "a", "na", "b", "nb"],
                    )
                    yield heads
                    rest = np.flatnonzero(node != least[group]) if len(new) else new
                    if len(rest):
                        pivot = least[group[rest]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[rest] ^ signed(sig[rest])), pa.array(signed(sig[rest])), pa.array(node[rest]), pa.array(n[o[rest]].astype(np.int32)), pa.array(pivot), pa.array(np.array([size_of[x] for x in pivot.tolist()], np.int32))],
                            names=["at", "sig", "a", "na", "b", "nb"],
                        )

        sent = self.docs.mapInArrow(run, "at long, sig long, a long, na int, b long, nb int")
        # pairs that a slice has found pass through, spread over the partitions
        bucket = Window.partitionBy("at", F.col("b").isNull()).orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        head = sent.select("sig", "a", "na", F.coalesce("b", F.first("a").over(bucket)).alias("b"), F.coalesce("nb", F.first("na").over(bucket)).alias("nb"))
        return stored(head.where("a <> b"), "jaccard-candidates")

    def sets(self, nodes: DataFrame, rows: DataFrame) -> DataFrame:
        """(node, n, grams, sketch words) of the given nodes, each from one of its documents."""
        # summed before the shuffle: copies of one text may be many
        chosen = rows.where("node is not null").groupBy("node").agg(F.min(F.xxhash64("doc_id", "key")).alias("h"))
        wanted = stored(chosen.join(nodes, "node"), "jaccard-nodes")
        shared = self.spark.sparkContext.broadcast(bitmap(wanted, "h", NODE_BITS))
        k = self.s.words
        names = ["id", "n", "grams", *(f"s{i}" for i in range(SKETCH))]

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, limit=2 << 20):
                    part = part.filter(pa.array(maybe(shared.value, np.asarray(part.column("h")).view(np.uint64))))
                    owner, grams = shingle_sets(part.column("text"), k)
                    n, ids = node_ids(owner, grams, part.num_rows)
                    keep = np.zeros(part.num_rows, bool)
                    keep[np.unique(ids, return_index=True)[1]] = True
                    keep &= n > 0
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(signed(grams)))
                    whole = pa.RecordBatch.from_arrays([pa.array(signed(ids)), pa.array(n), lists, *map(pa.array, sketches(owner, grams, part.num_rows))], names=names)
                    yield whole.filter(pa.array(keep))

        found = self.docs.withColumn("h", F.xxhash64("doc_id", "key")).mapInArrow(run, "id long, n long, grams array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH)))
        exact = found.join(wanted, F.col("id") == F.col("node")).drop("id", "h").dropDuplicates(["node"])
        return stored(exact, "jaccard-sets")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
        two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
        both = pairs.select("a", "b").join(one, "a").join(two, "b")
        common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("i"))
        return common.where(self.s.den * F.col("i") >= self.s.num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")

    def alike(self, na: str, nb: str) -> F.Column:
        return self.s.den * F.least(na, nb) >= self.s.num * F.greatest(na, nb)

    def prefix(self, n: F.Column, m: F.Column) -> F.Column:
        """Where the first common shingle of linked sets of n and of at least m shingles stands in the set of n, at the latest."""
        both = self.s.num + self.s.den
        return n + 1 - F.floor((self.s.num * (n + m) + both - 1) / both)

    def across(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members of buckets that hold several components, with their components and the bucket's size."""
        named = members.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
        named = stored(named, "jaccard-members")
        mixed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("sig", "k")
        return stored(named.join(mixed, "sig"), "jaccard-mixed")

    def few(self, mixed: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) across components in small buckets that sizes and sketches allow."""
        sketch = [f"s{i}" for i in range(SKETCH)]
        marked = stored((mixed if self.s.few is None else mixed.where(F.col("k") <= self.s.few)).join(sets.select(F.col("node").alias("a"), *sketch), "a"), "jaccard-marked")
        other = marked.select("sig", *(F.col(c).alias(f"_{c}") for c in ["a", "n", "comp", *sketch]))
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in sketch), F.lit(0))
        close = apart <= F.floor((F.col("n") + F.col("_n")) * (self.s.den - self.s.num) / (self.s.den + self.s.num))
        both = marked.join(other, "sig").where((F.col("a") < F.col("_a")) & (F.col("comp") != F.col("_comp")) & self.alike("n", "_n") & close)
        return both.select("a", F.col("_a").alias("b"))

    def many(self, mixed: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) across components among the members of large buckets whose prefixes meet."""
        num, den, n = self.s.num, self.s.den, F.col("n")
        members = mixed.where(F.col("k") > self.s.few).select("a", "comp").distinct()
        grams = sets.select(F.col("node").alias("a"), "n", "grams").join(members, "a").select("a", "n", "comp", F.explode("grams").alias("g"))
        # the shingles of several components; in the common order all others come before them
        shared = grams.groupBy("g").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g", "c")
        own = Window.partitionBy("a")
        placed = grams.join(shared, "g").withColumn("at", n - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "g")))
        least = F.floor((num * n + den - 1) / den)  # the fewest shingles of a set that links
        placed = stored(placed.where(F.col("at") <= n + 1 - least).select("a", "n", "comp", "g", "at"), "jaccard-prefixes")
        # every set as the smaller (x) and as the larger (y) of a pair, for each band in which the other may be
        key, band = ["g", "x_band", "y_band"], size_band(n)
        y_bands = F.explode(F.sequence(band, size_band(F.floor(n * den / num))))
        x_bands = F.explode(F.sequence(size_band(least), band))
        x = placed.select("*", band.alias("x_band"), y_bands.alias("y_band")).where(F.col("at") <= self.prefix(n, F.greatest(n, band_floor(F.col("y_band")))))
        y = placed.select("*", x_bands.alias("x_band"), band.alias("y_band")).where(F.col("at") <= self.prefix(n, F.greatest(least, band_floor(F.col("x_band")))))
        y = y.select(*key, *(F.col(c).alias(f"_{c}") for c in ["a", "n", "comp", "at"]))
        # components first, so that the members of one don't meet each other
        apart = x.select(*key, "comp").distinct().join(y.select(*key, "_comp").distinct(), key).where("comp <> _comp")
        both = apart.join(x, [*key, "comp"]).join(y, [*key, "_comp"]).where((F.struct("n", "a") < F.struct("_n", "_a")) & self.alike("n", "_n"))
        met = both.where((F.col("at") <= self.prefix(n, F.col("_n"))) & (F.col("_at") <= self.prefix(F.col("_n"), n)))
        return met.select(F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b"))

    def link_components(self, rows: DataFrame) -> DataFrame:
        """(node, comp) of the nodes that have links."""
        found = self.candidates()
        nodes = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
        sets = self.sets(nodes, rows)
        checked = stored(found.where(self.alike("na", "nb")).select("a", "b").distinct(), "jaccard-pairs")
        edges = stored(self.links(checked, sets), "jaccard-links")
        labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        members = stored(found.select("sig", "a", F.col("na").alias("n")).unionByName(found.select("sig", F.col("b").alias("a"), F.col("nb").alias("n"))).distinct(), "jaccard-buckets")
        mixed = self.across(members, labels)
        if mixed.isEmpty():
            return labels
        # another pivot for each bucket
        pivot = mixed.groupBy("sig").agg(F.min_by(F.struct("a", "n", "comp"), F.xxhash64("a")).alias("p"))
        again = mixed.join(pivot, "sig").where(F.col("comp") != F.col("p.comp")).select(F.least("a", F.col("p.a")).alias("x"), F.greatest("a", F.col("p.a")).alias("y"), "n", F.col("p.n").alias("m"))
        again = again.where(self.alike("n", "m")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        known = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        again = stored(again.join(known, ["a", "b"], "left_anti"), "jaccard-pairs")
        edges = stored(edges.unionByName(self.links(again, sets)), "jaccard-links")
        labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        mixed = self.across(members, labels)
        if mixed.isEmpty():
            return labels
        last = self.few(mixed, sets)
        if self.s.few is not None:
            last = last.unionByName(self.many(mixed, sets))
        last = last.distinct().join(known.unionByName(again), ["a", "b"], "left_anti")
        new = stored(self.links(last, sets), "jaccard-links")
        if new.isEmpty():
            return labels
        return components(edges.unionByName(new).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def run(self) -> DataFrame:
        """(doc_id, key, n_shingles, node, comp, component_id); comp is a node of the component, where ids may be null or repeated."""
        rows = self.rows()
        classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        linked = self.link_components(rows)
        tops = linked.join(classes, "node").groupBy("comp").agg(F.min("least").alias("top"))
        final = linked.join(tops, "comp").select("node", "comp", "top")
        names = stored(classes.join(final, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("top", "least").alias("component_id")), "jaccard-names")
        return rows.join(names, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "node", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return Join(docs, s).run().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each component: the one of the least id; rows without words all stay, repeated ones too."""
    found = stored(Join(docs, s).run(), "jaccard-result")
    best = found.where("node is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k"))
    wordless = found.where("node is null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_k")).distinct()
    named = best.select(F.col("k.doc_id").alias("_id"), F.col("k.key").alias("_k"), F.lit(False).alias("_all")).unionByName(wordless.withColumn("_all", F.lit(True)))
    needed = ("doc_id", "text")
    keyed = pack(docs, *needed).withColumn("_key", F.xxhash64("text"))
    joined = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    once = Window.partitionBy("doc_id", "_key").orderBy("doc_id")
    return unpack(joined.withColumn("_n", F.row_number().over(once)).where("_n = 1 or _all"), docs.columns, needed)


def production() -> Settings:
    """The join of query op8: three words, 0.9; by all pairs, as prefixes make too many rows in one large group of near copies."""
    return Settings(words=3, num=90, den=100, few=None)


