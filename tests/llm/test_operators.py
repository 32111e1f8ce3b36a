"""Every operator against brute force, on awkward rows, on an empty table and on the driver's smallest table."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelia.llm import jaccard, licenses, lm, media, mixing, neighbours, secrets, sentencepieces, substrings, toxicity, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_row(frame):
    """Rows by (id, text), since ids repeat."""
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# --- 1: secrets


def base_spans(text):
    text = text or ""
    pattern = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def render(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_secrets_base(table, request):
    docs = request.getfixturevalue(table)
    got = collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.secrets(docs).collect())
    want = collections.Counter()
    for i, t in by_row(docs):
        s = base_spans(t)
        want[(i, *(sum(k == n for _, k, _ in s) for n in range(3)), hashlib.sha256(render(s).encode()).hexdigest())] += 1
    assert got == want


def test_secrets_method(spark, small):
    secret, word = "Qx7Rz2LmP0vTn8KdWq3YsB5h", "international_organisation_of_standards"
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, f"see {secret} here and {word} there")], "doc_id long, text string"))
    rows = {r["doc_id"]: r["spans"] for r in secrets.secrets(docs).collect()}
    assert rows[10**6] == f"markov:4:{4 + len(secret)}"
    # base spans stay, and ordinary words are left alone
    for i, t in by_row(docs):
        spans = rows[i].split(",") if rows[i] else []
        assert set(filter(None, render(base_spans(t)).split(","))) <= set(spans)


def test_method_spans_inside_base_spans_are_left_out(spark, small):
    """By plain loops, on texts of many spans too."""
    rng = np.random.default_rng(4)
    secret = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    texts = [" ".join(f"{('token=', '', 'x ')[i % 3]}{secret(24)}" for i in range(n)) for n in (1, 7, 2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.train(small)
    for r in secrets.find(docs, model).select("doc_id", "_base", "_all").collect():
        base = [(b["start"], b["kind"], b["end"]) for b in r["_base"]]
        likely = []
        for m in re.finditer(secrets.CANDIDATE, texts[r["doc_id"]]):
            places = [secrets.ALPHABET.index(c) for c in m[0]]
            ratio = sum(model[a * len(secrets.ALPHABET) + b] for a, b in itertools.pairwise(places)) / (len(places) - 1)
            if ratio > secrets.THRESHOLD and not any(a <= m.start() and m.end() <= b for a, _, b in base):
                likely.append((m.start(), 3, m.end()))
        assert [(x["start"], x["kind"], x["end"]) for x in r["_all"]] == sorted(base + likely)


def test_redact(awkward):
    out = secrets.redact(awkward)
    assert out.columns == awkward.columns
    rows = collections.Counter(r["text"] for r in out.collect())
    assert rows[f"{secrets.MARK}\" token: abc"] == 1
    assert rows[f"{secrets.MARK} and {secrets.MARK} end"] == 1
    assert rows[None] == 1 and sum(rows.values()) == awkward.count()


def test_running_sums_over_blocks(spark):
    n = 2 * secrets.BLOCK + 3
    frame = spark.range(1).selectExpr(f"transform(sequence(1, {n}), x -> cast(x as long)) as v")
    assert frame.select(secrets.running(frame.v)).first()[0] == list(itertools.accumulate(range(1, n + 1)))


# --- 2: mixing


def test_schedule_deviates_less_than_a_block():
    for quota in ({"a": 500, "b": 300, None: 200}, {"a": 1, "b": 1, "c": 998}, {"a": 7}, {str(i): i + 1 for i in range(30)}):
        period = sum(quota.values())
        placed = collections.Counter()
        table = mixing.period_schedule(quota)
        assert [t for _, _, t in table] == list(range(period))
        for name, block, slot in table:
            release, deadline = mixing.window(block, quota[name], period)
            assert release <= slot < deadline
            placed[name] += 1
            assert all(abs(placed[s] - q * (slot + 1) / period) < 1 for s, q in quota.items())


def test_mixing(awkward, empty, small):
    s = mixing.Settings(block_chars=500, slots=50)
    rows = mixing.schedule(awkward, s).collect()
    assert len(rows) == awkward.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["before"], r["block"], r["slot"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(b // 500 == block for v in by.values() for b, block, _ in v)
    assert mixing.mix(empty).count() == 0 and mixing.interleave(empty).count() == 0
    mixed = mixing.interleave(small, mixing.Settings(weights={"src0": 1.0, "src1": 3.0}, block_chars=500))
    assert mixed.columns == small.columns
    assert {r["source"] for r in mixed.select("source").distinct().collect()} <= {"src0", "src1"}
    assert mixing.interleave(awkward, s).columns == awkward.columns
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(small, mixing.Settings(max_sources=2))


# --- 3: SentencePiece


def test_pieces_equal_the_library(awkward, small, empty):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    for docs in (awkward, small):
        out = sentencepieces.encode_documents(docs, verify_every=1)
        taken = {c.lower() for c in docs.columns}
        name = "_ids" if "ids" in taken else "ids"
        for r in out.collect():
            assert r[name] == own.encode(r["text"] or "") and r["n_tokens"] == len(r[name]) and r["round_trip"] and r["parity"]
    assert sentencepieces.encode_documents(empty).count() == 0


def test_whole_text_tokenizer_and_decoding(spark):
    codec = sentencepieces.Codec(open(sentencepieces.MODEL, "rb").read())
    texts = ["", " ", "a  b", " lead", "trail ", "tab\tand\nline", "日本 <s> <0x41>", "x" * 300]
    ids, offsets, decoded = codec.encode_texts(pa.array(texts))
    for i, t in enumerate(texts):
        part = ids[offsets[i] : offsets[i + 1]].tolist()
        assert part == codec.tokenizer.encode(t, add_special_tokens=False).ids
        assert codec.decode_ids([part]) == [t] and decoded[i].as_py() == t
    frame = spark.createDataFrame([(1, [int(x) for x in ids[offsets[5] : offsets[6]]]), (2, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in sentencepieces.decode_documents(frame).orderBy("doc_id").collect()] == [texts[5], ""]


def test_unigram_models_are_rebuilt():
    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -4.0, 1), ("a", -3.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    data += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 1]))
    codec = sentencepieces.Codec(data)
    ids, offsets, decoded = codec.encode_texts(pa.array(["ab", " a  b "]))
    assert ids[: offsets[1]].tolist() == [3] and decoded[0].as_py() == "ab" and decoded[1].as_py() == "a b"


# --- 4: language model


def brute_lm(rows, s):
    tokens = {k: [*SPACE.findall(lower(t)), None] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % s.folds]
    c, pair = collections.Counter(), collections.Counter()
    for k in train:
        c.update(tokens[k])
        pair.update(itertools.pairwise(tokens[k]))
    n, z = sum(c.values()), sum(c.values()) + s.add * (len(c) + 1)
    out = []
    for k, (i, _) in enumerate(rows):
        u = [(c[w] + s.add) / z for w in tokens[k]]
        p = [u[0]] + [(pair[a, b] + s.prior * x) / (c[a] + s.prior) for (a, b), x in zip(itertools.pairwise(tokens[k]), u[1:], strict=True)]
        out.append((i, k not in train, len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, sum(map(math.log10, u)), sum(map(math.log10, p))))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [16 << 20, 100])
def test_language_model(awkward, small, slice_bytes):
    s = lm.Settings(slice_bytes=slice_bytes, least_buckets=7)
    for docs in (awkward, small):
        got = sorted((tuple(r)[:7] for r in lm.language_model_scores(docs, s).collect()), key=str)
        want = brute_lm(by_row(docs), s)
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5])), strict=True):
            assert g[:5] == w[:5]
            assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_language_model_without_documents(empty):
    assert lm.language_model_scores(empty).count() == 0


# --- 5: licenses


def test_licenses(awkward, small, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for docs in (awkward, small):
        got = collections.Counter(tuple(r)[:6] for r in licenses.licenses(docs).collect())
        want = collections.Counter()
        for i, t in by_row(docs):
            w = word.findall(lower(t))
            at = [(p, label) for p in range(len(w)) for phrase, label in licenses.PHRASES.items() if w[p : p + len(phrase.split())] == phrase.split()]
            want[(i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
        assert got == want
    assert licenses.licenses(empty).count() == 0


def test_license_diagonals(spark):
    notice = "Permission is hereby granted free of charge to any person obtaining a copy of this extra software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software"
    docs = spark.createDataFrame([(1, notice), (2, "permission is hereby granted to leave"), (3, "Released under the MIT License. " * 2)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    assert "mit" in rows[1]["labels"].split(",") and 0.9 < rows[1]["score"] <= 1
    assert rows[2]["labels"] == "" and 0 < rows[2]["score"] < 0.6
    assert rows[3]["labels"] == "mit" and rows[3]["score"] == 1 and rows[3]["n_base"] == 2


def test_licenses_are_told_apart(spark):
    texts = dict(licenses.TEMPLATES[::-1])
    gpl2 = next(t for label, t in licenses.TEMPLATES if label == "gpl-2.0")
    cases = [
        ("She studied under the MIT programme.", ""),
        ("It was released under the MIT programme.", ""),
        (next(t for label, t in licenses.TEMPLATES if label == "cc-by-nc-4.0" and "Creative" in t), "cc-by-nc-4.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-NC 3.0.", "cc-by"),
        (gpl2, "gpl,gpl-2.0"),
        (gpl2.replace("version 2", "version 3"), "gpl,gpl-3.0"),
        (gpl2.replace("GNU General", "GNU Affero General"), ""),
        (texts["lgpl"], "lgpl"),
        (f"{texts['mit']} Licensed under the Apache License, Version 2.0. {texts['isc']}", "apache,apache-2.0,isc,mit"),
        ("Released under the MIT License. " * 3 + "Licensed under the Apache License, Version 2.0", "apache,apache-2.0,mit"),
        (" ".join(w + " and" for w in texts["unlicense"].split()), ""),
        (texts["bsd"].replace("source", "the original source"), "bsd"),
    ]
    rows = {r["doc_id"]: r["labels"] for r in licenses.licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(cases))] == [x for _, x in cases]


def brute_spans(text):
    """Verified spans of every template: labels and score, by plain loops."""
    w = licenses.template_words(lower(text))
    spans = []
    for n, (label, template) in enumerate(licenses.TEMPLATES):
        t = licenses.template_words(template)
        hits = sorted({(at - i, at, i) for at in range(len(w) - 2) for i in range(len(t) - 2) if w[at : at + 3] == t[i : i + 3]})
        islands = []
        for h in hits:
            if not islands or h[0] - islands[-1][-1][0] > licenses.GAP:
                islands.append([])
            islands[-1].append(h)
        for island in islands:
            own, there = ({x + j for h in island for x in [h[k]] for j in range(3)} for k in (1, 2))
            a, b = min(own), max(own) + 1
            agrees = [x for x in w[a:b] if re.match(licenses.KEY, x)] == [x for x in t if re.match(licenses.KEY, x)]
            share = min(len(own), len(there)) / max(len(t), b - a)
            spans.append((min(len(own), len(there)) if agrees and share >= licenses.MIN_SHARE else 0, a, b, n, label, share if agrees else share / 2))
    spans.sort(key=lambda s: (s[1], s[2], s[3]))
    groups = []
    for s in spans:
        if not groups or s[1] >= max(x[2] for x in groups[-1]):
            groups.append([])
        groups[-1].append(s)
    kept = []
    for g in groups:
        top = max(g, key=lambda s: (s[0], s[1] - s[2], -s[3]))
        kept += [s for s in g if s is top or s[1] >= top[2] or s[2] <= top[1]]
    return {s[4] for s in kept if s[0]}, max((s[5] for s in kept), default=0.0)


def test_license_labels_by_brute_force(awkward, small):
    for docs in (awkward, small):
        got = collections.defaultdict(list)
        for r in licenses.licenses(docs).collect():
            got[r["doc_id"], r["n_words"]].append((set(r["labels"].split(",")) - {""}, set(r["base_labels"].split(",")) - {""}, r["score"]))
        for i, t in by_row(docs):
            labels, score = brute_spans(t or "")
            assert any(have == base | labels and s == pytest.approx(score) for have, base, s in got[i, len(licenses.template_words(lower(t)))])


# --- 6: neighbours


def brute_nearest(ids, vectors, k):
    out = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((vectors - q) ** 2).sum(1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_neighbours_recall_and_distances(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    for s in (neighbours.Settings(), neighbours.Settings(shard_rows=700, query_block=8)):
        got = collections.defaultdict(list)
        for r in neighbours.nearest(frame, s).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        want = brute_nearest(ids, vectors, 10)
        assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
        hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hit / (10 * len(want)) >= 0.9
        exact = {(q, v): d for q in want for v, d in want[q]}
        assert all(d == pytest.approx(exact[q, v], rel=1e-12) for q in got for v, d in got[q] if (q, v) in exact)


def test_neighbours_queries_go_to_resident_indexes(spark):
    # no join carries an index with a block of queries; many blocks give what one gives
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(900)], "vec_id long, embedding array<double>")
    found = [neighbours.nearest(frame, neighbours.Settings(shard_rows=200, query_block=b), "vec_id % 50 = 0") for b in (4, 1000)]
    assert "Join" not in found[0]._jdf.queryExecution().analyzed().toString()
    one, other = (sorted(map(tuple, f.collect())) for f in found)
    assert one == other and len(one) == 180


def test_neighbours_awkward_vectors(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(0, one), (100, [5.0, 5.0, 5.0]), (200, [1.0, 2.0]), (1, one), (2, one), (3, [1.0, 0.0, 2.5]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [1.0, float("nan"), 1.0]), (8, [1.0, 3.0]), (None, one)]
    rows += [(1000 + i, one) for i in range(1, 50)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert [v for _, v, _ in got[0]] == [1, 2, *range(1001, 1009)]
    assert got[200] == [(1, 8, 1.0)]
    assert [v for _, v, _ in got[100]] == [3, 0, 1, 2, *range(1001, 1007)]
    assert neighbours.nearest(frame.limit(0)).count() == 0


# --- 7: toxicity


def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    own = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(awkward, own).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, own).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.toxicity(awkward, own.limit(0)).collect())
    assert toxicity.keep_clean(awkward, own.limit(0)).columns == awkward.columns


def test_pairs_count_beyond_single_terms():
    rng = np.random.default_rng(1)
    filler = [f"f{i}" for i in range(50)]
    texts, y = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*rng.choice(filler, 8), *["insult"] * int(a), *["group"] * int(b)]))
        y.append(int(a and b))
    s = toxicity.Settings(min_log_odds=0.1, min_z=1.0, epochs=400)
    model = toxicity.fit_texts(pa.array(texts), np.array(y), s)
    p = toxicity.score_texts(pa.array(["f1 insult group", "f1 insult", "f1 group", "f1"]), model)
    assert p[0] > 0.5 and (p[1:] < 0.5).all()


def test_a_label_of_pairs_alone_at_shipped_settings():
    """Neither word tells the labels apart: label 1 means both or none of them."""
    rng = np.random.default_rng(2)
    filler = [f"f{i}" for i in range(60)]
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*rng.choice(filler, 10), *["insult"] * int(a), *["group"] * int(b)]))
        y.append(int(a == b))
    model = toxicity.fit_texts(pa.array(texts), np.array(y))
    held = pa.array(["f1 f2 insult group", "f3 f9 f4", "f1 insult f7", "group f8 f5"])
    p = toxicity.score_texts(held, model)
    assert (p[:2] > 0.8).all() and (p[2:] < 0.2).all()
    linear = toxicity.Model(model.terms, model.weights, np.zeros_like(model.factors), model.bias)
    assert not ((q := toxicity.score_texts(held, linear))[:2] > 0.5).all() or not (q[2:] < 0.5).all()


def test_scores_are_those_of_the_formula():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "alphabet", "beta", "gamma", "delta.", "(delta)", "x"], 6)) for _ in range(200)]
    model = toxicity.fit_texts(pa.array(texts), rng.integers(0, 2, 200), toxicity.Settings(min_log_odds=0.0, min_z=0.0, epochs=20))
    place = {int(t): i for i, t in enumerate(model.terms)}
    for text, p in zip(texts[:40], toxicity.score_texts(pa.array(texts[:40]), model), strict=True):
        vectors = []
        for w in sorted({w.strip(toxicity.EDGE) for w in text.lower().split()} - {""}):
            terms = [words.hash_strings(pa.array([w]))[0]] + [words.hash_strings(pa.array([w[:n]]), n)[0] for n in toxicity.PREFIXES if len(w) > n]
            vectors.append((sum(model.weights[place[int(t)]] for t in terms if int(t) in place), sum((model.factors[place[int(t)]] for t in terms if int(t) in place), np.zeros(8))))
        z = model.bias + sum(a for a, _ in vectors) + sum(u @ v for (_, u), (_, v) in itertools.combinations(vectors, 2))
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


# --- 8: Jaccard join


def brute_components(rows, s):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[p : p + s.words]) for p in range(max(1, len(w) - s.words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and s.den * len(sets[a] & sets[b]) >= s.num * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("settings", [jaccard.production(), jaccard.Settings()])
def test_jaccard(awkward, small, empty, settings):
    for docs in (awkward, small):
        assert collections.Counter(tuple(r) for r in jaccard.jaccard_components(docs, settings).collect()) == brute_components(by_row(docs), settings)
    assert jaccard.jaccard_components(empty, settings).count() == 0


@pytest.mark.parametrize("settings", [jaccard.production(), jaccard.Settings()])
def test_linked_sets_share_a_signature(settings):
    """Pairs at the threshold, small sizes above all, where levels and one-deletion neighbourhoods matter."""
    rng = np.random.default_rng(5)
    for size in [*range(4, 60), 100, 333, 1000]:
        for _ in range(12):
            a = rng.integers(1, 2**63, size, dtype=np.uint64)
            drop = int(rng.integers(0, size // 3 + 1))
            add = int(rng.integers(0, size // 3 + 1))
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, add, dtype=np.uint64)])
            common = size - drop
            if not common or settings.den * common < settings.num * (size + add) or (drop == add == 0):
                continue
            a, b = np.unique(a), np.unique(b)
            owner, grams = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            of, sig = jaccard.signatures(owner, grams, np.array([len(a), len(b)]), settings)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_large_group_of_near_copies(spark):
    """Chains and borderline copies: components must be whole though buckets send few pairs."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[p] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for s in (jaccard.production(), jaccard.Settings()):
        assert collections.Counter(tuple(r) for r in jaccard.jaccard_components(docs, s).collect()) == brute_components(rows, s)


def test_alike_but_not_linked(spark, monkeypatch):
    """A family of alike texts that don't link: its pairs must not all be compared, and links within it be found."""
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(900)]
    rows = []
    for i in range(160):
        w, p = list(base), int(rng.integers(0, 790))
        w[p : p + 110] = [f"x{i}_{k}" for k in range(110)]
        rows.append((i, " ".join(w)))
        if i % 10 == 0:  # at the threshold, with other words changed
            for k in rng.choice(900, 17, replace=False):
                w[k] = f"y{i}_{k}"
            rows.append((1000 + i, " ".join(w)))
    compared = []
    links = jaccard.Join.links
    monkeypatch.setattr(jaccard.Join, "links", lambda self, pairs, sets: compared.append(pairs.count()) or links(self, pairs, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    s = jaccard.Settings()
    found = collections.Counter(tuple(r) for r in jaccard.jaccard_components(docs, s).collect())
    assert found == brute_components(rows, s)
    assert len(compared) == 3 and compared[-1] < 20 * len(rows)


def test_prefixes_hold_every_link(spark):
    """All linked pairs of sets across components, sizes of one to 3,000, are among those whose prefixes meet."""
    rng = np.random.default_rng(9)
    s = jaccard.Settings()
    sets = []
    for size in [*range(1, 40), 63, 64, 65, 100, 333, 1000, 3000]:
        a = rng.choice(2**40, size, replace=False)
        sets.append(set(a.tolist()))
        for _ in range(6):
            drop, add = (int(rng.integers(0, size // 5 + 2)) for _ in range(2))
            sets.append(set(a[drop:].tolist()) | set(rng.choice(2**40, add).tolist()))
    sets = [x for x in {frozenset(x) for x in sets if x}]
    link = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if s.den * len(sets[a] & sets[b]) >= s.num * len(sets[a] | sets[b])}
    join = jaccard.Join(spark.createDataFrame([], "doc_id long, text string"), s)
    table = spark.createDataFrame([(i, len(x), sorted(x)) for i, x in enumerate(sets)], "node long, n long, grams array<long>")
    for comps in (len(sets), 40):
        members = spark.createDataFrame([(0, i, len(x), i % comps, len(sets)) for i, x in enumerate(sets)], "sig long, a long, n long, comp long, k long")
        met = {tuple(r) for r in join.many(members, table).distinct().collect()}
        assert met >= {(a, b) for a, b in link if a % comps != b % comps} and all(a < b and a % comps != b % comps for a, b in met)


def test_keep_one(awkward):
    s = jaccard.Settings()
    out = jaccard.keep_one(awkward, s)
    assert out.columns == awkward.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert max(kept.values()) == 1
    groups = collections.defaultdict(set)
    for r in jaccard.Join(awkward, s).run().collect():
        groups[(r["component_id"], r["n_shingles"] > 0)].add(r["doc_id"])
    texts = collections.Counter(i for i, _ in kept)
    for (component, filled), members in groups.items():
        if filled and component is not None and component != 3:
            assert sum(texts[m] for m in members) == 1


# --- 9: substrings


def brute_dedup(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first = {}
    words = [SPACE.findall(t or "") for _, t in rows]
    for k in order:
        for p in range(len(words[k]) - substrings.K + 1):
            w = tuple(words[k][p : p + substrings.K])
            at = (rows[k][0] is not None, rows[k][0] or 0, p)
            first[w] = min(first.get(w, at), at)
    out = collections.Counter()
    for k, (i, _) in enumerate(rows):
        gone = [False] * len(words[k])
        for p in range(len(words[k]) - substrings.K + 1):
            if first[tuple(words[k][p : p + substrings.K])] != (i is not None, i or 0, p):
                gone[p : p + substrings.K] = [True] * substrings.K
        kept = " ".join(w for w, g in zip(words[k], gone, strict=True) if not g)
        out[(i, len(words[k]), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substrings(awkward, small, empty):
    for docs in (awkward, small):
        assert collections.Counter(tuple(r) for r in substrings.dedup(docs).collect()) == brute_dedup(by_row(docs))
    assert substrings.dedup(empty).count() == 0


def test_substrings_over_slices(awkward, monkeypatch):
    """Slices of one row: every repeat must be found across slices too."""
    parts = [awkward.where(f"coalesce(doc_id, -1) % 4 = {k}") for k in (-1, 0, 1, 2, 3)]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    rows = {(r["doc_id"], r["kept_text"]) for r in substrings.dedup(docs, with_text=True).collect()}
    assert len(rows) >= 20
    assert collections.Counter(tuple(r) for r in substrings.dedup(docs).collect()) == brute_dedup(by_row(docs))


def test_repeated_passages_compact_into_paths(spark):
    """A passage is one path; where its copies go on differently, paths branch and end."""
    w = lambda name, n: [f"{name}{i}" for i in range(n)]
    shared, fork = w("s", 200), w("f", 60)
    rows = [
        (1, w("a", 30) + shared + w("b", 30)),
        (2, shared + w("c", 25)),
        (3, w("d", 5) + fork + w("x", 40)),
        (4, w("e", 7) + fork + w("x", 40)),
        (5, fork + w("y", 40)),
        (6, fork + w("y", 40)),
        (7, ["same"] * 70),
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["a"], r["n_words"]) for r in substrings.repeated_paths(docs).collect())
    # a loop of one word is an edge; the fork's windows end where its copies part, and both branches are paths
    assert got == [(1, 30, 200), (3, 5, 60), (3, 46, 59), (5, 41, 59), (7, 0, 20)]
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(docs).collect()}
    assert removed == {1: 0, 2: 200, 3: 0, 4: 100, 5: 60, 6: 100, 7: 69}


# --- 10: media


def test_media(awkward, small, empty):
    for docs in (awkward, small):
        got = collections.Counter(tuple(r)[:7] for r in media.media_digest(docs).collect())
        want = collections.Counter()
        for i, t in by_row(docs):
            data = (t or "").encode()
            payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
            wav = media.write_wav(payload)
            want[(i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())] += 1
        assert got == want
    features = collections.defaultdict(set)
    for r in awkward.join(media.media_digest(awkward).select("doc_id", "media_sha256", "feature"), "doc_id").collect():
        features[r["media_sha256"]].add(r["feature"])
    assert all(len(f) == 1 for f in features.values())
    assert media.media_digest(empty).count() == 0


def test_wav_is_read_by_the_standard_library(tmp_path):
    import wave

    path = tmp_path / "a.wav"
    path.write_bytes(media.write_wav(bytes(range(256)) * 9))
    with wave.open(str(path)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())) == (1, 1, media.RATE_IN, bytes(range(256)) * 9)


def test_media_features():
    t = np.arange(media.RATE_IN)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE_IN)).astype(np.uint8)
    quiet = np.full(4 * media.RATE_IN, 128, np.uint8)
    mels, spans = media.features(np.concatenate([quiet, tone, quiet]).tobytes())
    assert len(spans) == 1 and spans[0] == pytest.approx((4.0, 5.0), abs=0.05)
    assert np.argmax(mels[int(4.5 * media.RATE_OUT / media.HOP)]) == np.argmax(media.filters()[2][int(round(1000 * media.FRAME / media.RATE_OUT))])
    # polyphase output equals filtering followed by decimation
    x = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    taps = media.filters()[0].T.ravel()
    n = media.TAPS * media.DOWN
    full = np.convolve(np.concatenate([np.zeros(n // 2), x, np.zeros(n)]), taps[::-1], "valid")[:: media.DOWN][: len(x) // media.DOWN]
    assert np.allclose(media.resample(x), full, atol=1e-4)


def test_tensors(awkward):
    rows = media.tensors(awkward).collect()
    chunks = collections.Counter((r["doc_id"]) for r in rows if r["chunk"] == 0)
    assert sum(chunks.values()) == awkward.count()
    array = media.tensor_array(pa.array([r["tensor"] for r in rows]))
    assert array.type.shape == [media.FRAMES, media.MELS] and len(array) == len(rows)
    assert all(r["start_s"] < r["end_s"] and 1 <= r["n_frames"] <= media.FRAMES for r in rows)
