"""The training-data operators on a small table of awkward rows, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(150)) for _ in range(12)]
    out = [None, "", " ", "a", "two words", "a " * 300, "ab" * 400, "x\n\ny  z\n", base[0], base[0]]
    for b in base:
        w = b.split()
        out += [b, " ".join(w[:70] + ["CHANGED"] + w[71:]), " ".join(w[40:110]) + " " + " ".join(rng.choice(vocab) for _ in range(60)), "### " + b + "\n" + b]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None, "score") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def words(t):
    return WORD.findall(t or "")


def test_tokens(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from karst.llm.token_files import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_files(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files(empty, path).count() == 0


def test_near_groups(docs, empty):
    from karst.llm.superminhash import keep_one, near_groups

    sets = []
    for t in TEXTS:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = [(i, len(s), group[i], group[i] == i) for i, s in enumerate(sets)]
    assert rows(near_groups(docs, 85), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_groups(empty, 85).count() == 0
    assert rows(keep_one(docs.union(docs), 85), "doc_id") == [(i,) for i in range(len(sets)) if group[i] == i]


def test_suffix_dedup(docs, empty):
    from karst.llm.suffix_dedup import dedup_substrings

    first, want = set(), []
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in first:
                gone[p : p + 100] = True
            first.add(b[p : p + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert rows(dedup_substrings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert dedup_substrings(empty).count() == 0


def test_recompression(docs, empty):
    from karst.llm.recompression import dedup_windows

    seen = collections.Counter(tuple(w[p : p + 35]) for t in TEXTS for w in [words(t)] for p in range(len(w) - 34))
    want = []
    for i, t in enumerate(TEXTS):
        w, gone = words(t), set()
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone |= set(range(p, p + 35))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert rows(dedup_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert dedup_windows(empty).count() == 0


def test_suffix_array():
    from karst.llm.induced import suffix_array

    rng = np.random.default_rng(1)
    for _ in range(100):
        t = rng.integers(0, int(rng.integers(1, 4)) + 1, int(rng.integers(0, 60))).astype(np.uint8)
        b = t.tobytes()
        assert suffix_array(t, 1000, memory=int(rng.integers(1, 40))).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_quality(spark, docs, empty):
    from karst.llm.quality_rules import keep_good, quality_rules
    from karst.llm.quality_svm import score_quality

    labels = spark.createDataFrame([(i, 0 if (t or "").startswith("###") else 1) for i, t in enumerate(TEXTS)], "doc_id long, quality int")
    s = score_quality(docs, labels).collect()
    assert len(s) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in s)
    assert np.mean([r.predicted == (not (TEXTS[r.doc_id] or "").startswith("###")) for r in s if len(TEXTS[r.doc_id] or "") > 500]) > 0.8
    for r in quality_rules(docs, labels).collect():
        t = TEXTS[r.doc_id] or ""
        w = words(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cov = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert keep_good(docs, labels).columns == docs.columns
    assert score_quality(empty, labels).count() == 0 and quality_rules(docs, labels.where("false")).count() == len(TEXTS)


def test_language_model(docs, empty):
    from karst.llm.lbl_lm import score

    toks = [[*words((t or "").translate(LOW)), None] for t in TEXTS]
    c = collections.Counter(x for i, w in enumerate(toks) if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    for r in score(docs).collect():
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and r.score < 0
    assert score(empty).count() == 0


def test_language_model_trains_on_every_token(spark):
    import pyarrow as pa

    from karst.llm.arrowtext import Texts
    from karst.llm.lbl_lm import CLASSES, Symbols, new_params, tokens, train

    text = " ".join(f"w{i}" for i in range(200))
    heads = np.unique(tokens(Texts(pa.array([text]), lower=True))[0]).view(np.int64)
    n = Symbols(heads).n
    noise = np.full(n, 1 / n)
    assert n == 201 + CLASSES
    before, after = new_params(n, noise), train(spark.createDataFrame([(text,)], "text string"), heads, noise)
    moved = (np.abs(before["r1"] - after["r1"]) > 1e-5).any(axis=1)
    assert moved.sum() == 201  # each word, and the start, comes before one token


def test_log_probs_are_normalised():
    from karst.llm.lbl_lm import log_probs, new_params

    p = new_params(20, np.full(20, 0.05))
    sym = np.arange(20, dtype=np.int32)
    assert np.exp(log_probs(sym, np.full(20, 3), np.full(20, 20), p)).sum() == pytest.approx(1)


def test_decontamination(spark, docs):
    from karst.llm.decontam import contamination, decontaminate

    bench = spark.createDataFrame([(1, " ".join(TEXTS[10].split()[20:60]).upper().replace("É", "é")), (2, "two words"), (3, None), (4, "!!")], "item_id long, text string")
    r = {x.doc_id: x for x in contamination(docs, bench).collect()}
    assert r[10].n_hit == 40 and r[10].contaminated and r[4].n_hit == 2 and r[0].n_hit == 0 and not r[0].contaminated
    left = {x.doc_id for x in decontaminate(docs, bench).collect()}
    assert left == {i for i, x in r.items() if not x.contaminated}
    assert contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_mixing(docs, empty):
    from karst.llm.pfair import in_order, mix, one_period, quantise

    shares = quantise({"a": 5, "b": 3, "c": 1.7}, 100)
    n = collections.Counter()
    for s, j, release, deadline, slot in one_period(shares):
        n[s] += 1
        assert release <= slot < deadline and all(abs(n[x] - shares[x] * (slot + 1) / 100) < 1 for x in shares)
    m = mix(docs, block_bytes=500).collect()
    assert len(m) == len(TEXTS) and all(x.release <= x.slot < x.deadline for x in m)
    assert rows(in_order(docs), "doc_id") == [(i,) for i in range(len(TEXTS))] and mix(empty).count() == 0


def test_warc(spark):
    from karst.llm.warc import archive_pages, member, record, salvage

    html = ["<p>a</p>", None, "<p>a</p>", "x" * 70000, "é", ""]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    want = []
    for i, h in enumerate(html):
        b = (h or "").encode()
        top = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top))
    assert rows(archive_pages(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert archive_pages(pages.where("false")).count() == 0
    for pack in (member, bytes):
        parts = [pack(record(i, "u", b"p%d" % i * 50, None, False)) for i in range(4)]
        hurt = bytearray(parts[1])
        hurt[len(hurt) // 2] ^= 255
        data = parts[0] + bytes(hurt) + b"junk" + parts[2] + parts[3][:-9]
        got = list(salvage(data))
        whole = ["<urn:page:3>"] if pack is member else []  # there only the checksum at the end is cut off
        assert [g[3]["record_id"] for g in got if g[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", *whole]
        assert [(a, z) for k, a, z, _ in got if k == "gap"] == [(len(parts[0]), len(parts[0] + parts[1]) + 4), (len(data) - len(parts[3]) + 9, len(data))]


def test_salvage_inside_members():
    from karst.llm.warc import member, record, salvage

    rng = random.Random(1)
    raw = [record(i, "u", rng.randbytes(40_000), None, False) for i in range(3)]
    hurt = bytearray(raw[1])
    hurt[len(hurt) // 2] ^= 255
    after = member(record(8, "u", b"x", None, False))
    ids = lambda data: [g[3]["record_id"][10:-1] for g in salvage(data) if g[0] == "record"]
    gaps = lambda data: [g[1:3] for g in salvage(data) if g[0] == "gap"]
    one = member(raw[0] + bytes(hurt) + raw[2])
    assert ids(one + after) == ["0", "2", "8"] and gaps(one + after) == [(0, len(one))]
    cut_off = member(b"".join(raw))[:-50_000]
    assert ids(cut_off + after) == ["0", "8"] and gaps(cut_off + after) == [(0, len(cut_off))]
    assert ids(b"") == [] == gaps(b"") and gaps(b"junk") == [(0, 4)]


def test_long_and_marked_words():
    """Regular words of 1024 bytes and more, which polynomial hashes do not tell apart, and an added token's spelling."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from karst.llm.arrowtext import Texts
    from karst.llm.quality_rules import counts
    from karst.llm.token_files import Encoder

    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    t = Texts(pa.array([f"{a}\n{b}\n{a}"]))
    t.split()
    h = t.word_hashes()
    assert h[0] == h[2] != h[1] and counts(t)["n_dup_lines"].tolist() == [1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [a, b, "x <|endoftext|> y", "hello<|endoftext|>world", None]
    ids, off = Encoder(path).encode(pa.array(texts))
    tok = Tokenizer.from_file(path)
    assert [ids[i : j - 1].tolist() for i, j in zip(off[:-1], off[1:], strict=True)] == [tok.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_fits_take_long_texts(docs, spark):
    from karst.llm.linear import fitted, labelled

    long = spark.createDataFrame([(99, "long word " * 6000), (99, "other"), (100, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(99, 1), (99, 0), (100, 0), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in labelled(long, labels, 6000).collect()}
    assert got[99].text == "long word " * 6000 and got[99].quality == 1 and got[100].text == ""
    assert fitted(long, labels, 6000, lambda text, y: (len(text), y.tolist())) == (2, [1, 0])
    assert fitted(long.where("false"), labels, 6000, lambda text, y: len(text)) == 0


def test_stages_on_awkward_tables(spark, docs, empty, tmp_path):
    """Every stage of the pipeline, over tables with clashing names and over empty ones, and over a text of 5 MB."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([(i, 0 if (t or "").startswith("###") else 1) for i, t in enumerate(TEXTS)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(TEXTS[14].split()[20:60])), (None, TEXTS[14]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = spark.createDataFrame([(1000, " ".join(f"n{i}" for i in range(700_000)))], "doc_id long, text string")
    d = docs.select("doc_id", "text", "source").unionByName(long.withColumn("source", F.lit("s1")))
    for c in ("_th", "_d", "_t", "_nw", "_slot", "_at", "mix_index", "_file", "_row", "score", "_text", "n_words", "kept"):
        d = d.withColumn(c, F.lit(c))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, d, str(tmp_path))
        if name == "token_output":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in d.collect()}
        else:
            assert out.columns == d.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            d = spark.read.parquet(str(tmp_path / f"stage{k}"))
            assert d.where("_th = '_th' and _d = '_d' and _slot = '_slot' and kept = 'kept' and mix_index = 'mix_index'").count() == d.count() > 0
    assert d.where("doc_id = 1000").count() == 1 and d.where("doc_id = 14").count() == 0


def test_sql(spark):
    """The thin queries of operators that SQL can express."""
    import duckdb

    from karst.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for x in ("documents", "benchmark", "pages"):
        con.execute(f"create view {x} as select * from '{d}/{x}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, d)
        res = con.execute(sql)
        names = [x[0] for x in res.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in res.fetchall())


def test_null_ids_and_repeated_rows(spark):
    from karst.llm.decontam import contamination
    from karst.llm.lbl_lm import score
    from karst.llm.pfair import mix
    from karst.llm.recompression import dedup_windows
    from karst.llm.suffix_dedup import dedup_substrings
    from karst.llm.superminhash import near_groups

    t = " ".join(f"v{i}" for i in range(60))
    d = spark.createDataFrame([(None, t, "a"), (1, t, "a"), (1, t, "a"), (1, t + " more", None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, t)], "item_id long, text string")
    for f in (near_groups, dedup_substrings, dedup_windows, score, mix, lambda x: contamination(x, bench)):
        assert f(d).count() == 4


def test_quality_svm_against_plain_python():
    """The fit's ratios and hinge loss by loops over sets: the same ratios, and no weights with a lower loss."""
    import pyarrow as pa

    from karst.llm.quality_svm import BITS, _unit, dual_coordinate_descent, features, fit, ratios, score_column

    texts = [t or "" for t in TEXTS]
    y = np.array([0 if t.startswith("###") else 1 for t in texts])
    f, bound = features(pa.array(texts))
    sets = [f[i:j].tolist() for i, j in zip(bound[:-1], bound[1:], strict=True)]
    assert all(s == sorted(set(s)) for s in sets) and sets[0] == sets[1] == []
    p, q = (collections.Counter(x for s in one for x in s) for one in ([s for s, k in zip(sets, y, strict=True) if k == v] for v in (1, 0)))
    np_, nq = (1 << BITS) + sum(p.values()), (1 << BITS) + sum(q.values())
    r = ratios(f, bound, y, BITS)
    for i in sorted({*p, *q})[::97]:
        assert r[i] == pytest.approx(math.log((1 + p[i]) / np_) - math.log((1 + q[i]) / nq))

    x = _unit(f, bound, r)
    w, b = dual_coordinate_descent(f, x, bound, y, BITS, epochs=400)
    n = len(y)

    def loss(w, b):
        total = (sum(v * v for v in w.values()) + b * b) / 2
        for s, i, k in zip(sets, bound, y, strict=False):
            margin = sum(w.get(g, 0.0) * x[i + j] for j, g in enumerate(s)) + b
            total += n / (2 * max((y == k).sum(), 1)) * max(0.0, 1 - (1 if k else -1) * margin)
        return total

    own = {int(g): float(w[g]) for g in np.unique(f)}
    best, rng = loss(own, b), random.Random(5)
    assert best < loss({}, 0.0)
    for size in (1e-1, 1e-2):
        for _ in range(10):
            assert loss({g: v + size * rng.gauss(0, 1) * 0.1 for g, v in own.items()}, b + size * rng.gauss(0, 1)) > best - 1e-3
        assert loss({g: v * (1 + size) for g, v in own.items()}, b) > best - 1e-3 and loss({g: v * (1 - size) for g, v in own.items()}, b) > best - 1e-3

    m = fit(pa.array(texts), y)
    got = score_column(pa.array(texts), m)
    for i, s in enumerate(sets):
        norm = math.sqrt(sum(float(m["r"][g]) ** 2 for g in s))
        margin = (sum(float(m["w"][g]) for g in s) / norm if norm > 1e-9 else 0.0) + m["b"]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(m["a"] * margin + m["c"]))), rel=1e-4, abs=1e-6)


def test_mixing_against_a_loop_over_blocks(docs):
    """Every row's block, release, deadline and slot from its source's bytes, by a plain earliest-deadline loop over the slots; and no
    source a whole block off its weight at any slot before one runs out."""
    from karst.llm.pfair import mix, quantise

    weights, size, d = {None: 2, "s0": 5, "s1": 3, "s2": 1}, 300, 1000
    share = quantise(weights, d)
    got = mix(docs, weights, block_bytes=size).collect()
    by = collections.defaultdict(list)
    for x in got:
        assert x.n_bytes == len((TEXTS[x.doc_id] or "").encode())
        by[x.source].append(x)
    names = sorted(share, key=lambda s: (s is None, s))
    blocks = {}
    for s, of in by.items():
        at = 0
        for x in sorted(of, key=lambda x: (x.at, x.n_bytes > 0)):
            assert (x.at, x.block) == (at, at // size)
            at += x.n_bytes
        blocks[s] = -(-at // size)
    ends = max(x.slot for x in got) + 1
    taken, slot_of = dict.fromkeys(names, 0), {}
    for t in range(ends):
        ready = [s for s in names if taken[s] * d // share[s] <= t]
        s = min(ready, key=lambda s: (-(-(taken[s] + 1) * d // share[s]), names.index(s)))
        slot_of[s, taken[s]] = t
        taken[s] += 1
        assert all(abs(taken[x] * d - share[x] * (t + 1)) < d for x in names)
    horizon = min(slot_of.get((s, n), ends) for s, n in blocks.items())
    for x in got:
        assert x.slot == slot_of[x.source, x.block]
        assert (x.release, x.deadline) == (x.block * d // share[x.source], -(-(x.block + 1) * d // share[x.source]))
        assert x.in_balance == (x.slot < horizon)
