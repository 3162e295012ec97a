"""The library's own operators: fixtures in code, strategies against each other, and all queries against their SQL."""

import glob
import json
import os
import random

import duckdb
import pytest

from karst import catalog
from karst.operators import exact, hamming, leakage, resolve, score, vectors
from karst.operators.components import connected_components, with_singletons
from karst.plans import config
from karst.sources.images import read_annotations

SF = "/root/testdata/sf0.001"


def _pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_exact(spark):
    k = exact.with_key(spark.createDataFrame([("b.jpg", b"x"), ("a.jpg", b"x"), ("c.jpg", b"y")], "p string, c binary"), "p", "c")
    assert [(r.kept, r.removed) for r in exact.exact_groups(k).collect()] == [("a.jpg", ["b.jpg"])]
    p = exact.profile(k).first()
    assert (p.total_files, p.distinct_files, p.exact_duplicate_files, p.exact_duplicate_fraction) == (3, 2, 1, 0.3333)


@pytest.mark.parametrize("t", [0, 4, 12])
def test_hamming_strategies_agree(spark, monkeypatch, t):
    rng = random.Random(t)
    codes = [rng.getrandbits(64) for _ in range(120)]
    for c in codes[:30]:
        for b in rng.sample(range(64), rng.randint(0, 12)):
            c ^= 1 << b
        codes.append(c)
    rows = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "item_id long, code long")
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(codes[i] ^ codes[j]).count("1") <= t}
    for f in hamming.STRATEGIES.values():
        assert _pairs(f(rows, t)) == want
    monkeypatch.setattr(hamming, "block_size", lambda n: 20)  # many blocks in a cell
    for chunks in (None, hamming.ALL, hamming.split_bits(3, t), hamming.split_bits(max(t + 1, 2), t)):
        got = [(r.src, r.dst) for r in hamming.multi_index(rows, t, chunks=chunks).collect()]
        assert len(got) == len(want) and set(got) == want
    assert _pairs(hamming.pivot(rows, t)) == want
    cc = {r.item_id: r.component for r in with_singletons(rows.select("item_id"), hamming.linking_pairs(rows, t)).collect()}
    assert cc == {r.item_id: r.component for r in with_singletons(rows.select("item_id"), spark.createDataFrame(sorted(want) or [(0, 0)], "src long, dst long")).collect()}
    both = rows.selectExpr("item_id", "'a' algo", "code").union(rows.selectExpr("item_id", "'b' algo", "shiftleft(code, 1) code"))
    also = {(i, j) for i, j in want if bin((codes[i] ^ codes[j]) & ((1 << 63) - 1)).count("1") <= t}
    assert _pairs(hamming.pairs_on_all(both, ["a", "b"], t)) == also


def test_choices():
    assert hamming.choose_strategy("auto", 5000) == "bruteforce" and hamming.choose_strategy("auto", 5001) == "multiindex"
    assert hamming.choose_strategy("bk_tree", 1) == "bktree" == hamming.choose_strategy("bktree", 1)
    with pytest.raises(ValueError):
        hamming.choose_strategy("x", 1)
    cases = [((50_000, 768, "auto", 24), "flat"), ((2_000_000, 768, "auto", 64), "ivfflat"), ((20_000_000, 768, "auto", 64), "ivfpq"), ((500_000, 768, "auto", 0.1), "ivfpq"), ((20_000_000, 768, "flat", 24), "flat")]
    for args, want in cases:
        assert vectors.select_index(*args) == want


def test_components(spark):
    n = 3000
    chain = spark.range(n).selectExpr("id src", "id + 1 dst")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    out = with_singletons(spark.createDataFrame([(1,), (2,), (3,), (9,)], "item_id long"), spark.createDataFrame([(1, 2), (2, 7)], "src long, dst long"))
    assert {(r.item_id, r.component) for r in out.collect()} == {(1, 1), (2, 1), (7, 1), (3, 3), (9, 9)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_approximate_indexes(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    exact_pairs = _pairs(vectors.flagged_pairs(vectors.flat_knn(v, 100, 0.35), 0.35))
    ivf = _pairs(vectors.flagged_pairs(vectors.ivf_knn(v, 100, 32, 16), 0.35))
    assert ivf <= exact_pairs and len(ivf) >= 0.9 * len(exact_pairs)
    top = vectors.pq_knn(v, 1, 32, 8, 8, 8, True, 50).where("q = v").count()
    assert top >= 0.98 * v.count()
    with pytest.raises(ValueError):
        vectors.pq_knn(v, 1, 4, 2, 7)


def test_cosine_queries_keep_every_pair(spark, tmp_path, monkeypatch):
    e = [[1.0, 0.001 * (i // 2)] for i in range(240)] + [[-1.0, 0.0], [0.0, 0.0], [0.0, 0.0], None]
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(e)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {(i, j) for j in range(240) for i in range(j)}
    for size in (None, 50):  # one block, and several
        monkeypatch.setattr(vectors.blocks, "__defaults__", (size,))
        got = catalog.queries()["cosine_pairs_flat"](spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want
        comp = {r.item_id: r.component for r in catalog.queries()["semantic_components"](spark, str(tmp_path)).collect()}
        assert comp == {i: 0 if i < 240 else i for i in range(244)}


def test_registered_approximate_queries_recall(spark):
    import numpy as np

    d = "/root/testdata/sf0.1"
    t = spark.read.parquet(d + "/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toArrow()
    ids, x = t.column("vec_id").to_numpy(), vectors.matrix(t.column("embedding").combine_chunks())
    sim = x @ x.T
    want = {(int(ids[i]), int(ids[j])) for i, j in np.argwhere(np.triu(sim, 1) >= catalog.COSINE)}
    got = _pairs(catalog.queries()["ivfflat_pairs"](spark, d))
    assert got <= want and len(got) >= 0.9 * len(want)
    top = {(int(q), int(v)) for q, best in zip(ids, ids[np.argsort(-sim, axis=1, kind="stable")[:, :10]], strict=True) for v in best}
    got = {(r.q, r.v) for r in catalog.queries()["ivfpq_rerank"](spark, d).collect()}
    assert len(got & top) >= 0.9 * len(top)


def test_resolve(spark):
    cl = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "item_id string, component long")
    ann = spark.createDataFrame([("a", 1, 1, 10, [1]), ("b", 5, 2, 5, [1, 2])], "item_id string, num_boxes long, num_classes long, area long, class_ids array<long>")
    kept = lambda s, a=ann, e=None: {r.item_id for r in resolve.resolve(cl, a, s, e).where("kept").collect()}
    assert kept("keep_most_annotated") == {"b", "c"} and kept("keep_highest_res") == {"a", "c"} and kept("weighted_sample") == {"a", "b", "c"}
    apart = spark.createDataFrame([("a", 1, 1, 1, [1]), ("b", 1, 1, 1, [2])], ann.schema)
    assert kept("keep_most_annotated", apart) == {"a", "b", "c"}
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.1]), ("c", [0.0, 1.0])], "item_id string, embedding array<float>")
    assert "c" in kept("keep_central", ann, emb)
    items = spark.createDataFrame([(i, "v" if i < 6 else None) for i in range(7)], "i long, p string")
    assert {r.i for r in resolve.every_kth(items, 3, "p", ["i"]).collect()} == {0, 3, 6}


def test_leakage(spark):
    items = spark.createDataFrame([("t1", "train", "x"), ("v1", "val", "x"), ("v2", "val", "y"), ("t2", "train", "")], "item_id string, split string, partition_key string")
    r = {x.split: x for x in leakage.leakage_by_split(items, spark.createDataFrame([("t1", "v1")], "src string, dst string"), "train", ["val", "test"]).collect()}
    assert (r["val"].eval_images, r["val"].leaked_images, r["val"].leaked_fraction, r["val"].examples) == (2, 1, 0.5, "v1") and r["test"].eval_images == 0
    assert [(x.partition, x.splits) for x in leakage.partition_violations(items, "train", ["val"]).collect()] == [("x", "train,val")]


def test_score_and_report(spark):
    m = spark.createDataFrame([(1, 100, 10), (2, 90, 5), (3, 85, 15), (4, 100, 30)], "stage int, items_in long, items_removed long")
    t = score.report(m)[0].first()
    assert (t.initial_images, t.final_images, t.removed, t.reduction_fraction) == (100, 70, 30, 0.3)
    planted = spark.createDataFrame([("p", "o", "exact", 1)], "file string, original string, type string, expected_stage int")
    early = spark.createDataFrame([("p", "o", "near", 2), ("q", "o", "exact", 1)], planted.schema)
    members = spark.createDataFrame([(1, "g", x) for x in "poq"], "stage int, group string, name string")
    tiers = {r.tier: (r.caught, r.on_time) for r in score.recall_by_tier(early, members).collect()}
    assert tiers == {"near": (1, 0), "exact": (1, 1)}
    removed = spark.createDataFrame([("p",), ("z",)], "name string")
    assert score.precision(planted, removed).first().precision == 0.5
    assert score.precision(planted, removed.where("false")).first().precision == 1.0


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 5}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"image_id": 1, "category_id": 3}, {"image_id": 1, "category_id": 3}, {"image_id": 1}, {"image_id": 9, "category_id": 1}], "categories": []}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    r = {x.file_name: x for x in read_annotations(spark, "coco", str(tmp_path / "c.json")).collect()}
    assert (r["a.jpg"].num_boxes, r["a.jpg"].class_ids, r["a.jpg"].area, r["b.jpg"].num_boxes, r["b.jpg"].area) == (3, [3], 20, 0, 0)
    with pytest.raises(NotImplementedError):
        read_annotations(spark, "voc", "x")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("stage2: {hamming_threshold: 4}\n")
    c = config.load(str(tmp_path / "c.yaml"), ["stage3.fp16_embeddings=false", "seed=7"])
    assert (c.stage2.hamming_threshold, c.stage3.fp16_embeddings, c.seed, c.stage2.hash_size) == (4, False, 7, 8)
    with pytest.raises(KeyError):
        config.load(None, ["stage2.nope=1"])


def test_perceptual_kernels():
    import numpy as np

    from karst.functions.perceptual import ALGORITHMS, pack

    rng = np.random.default_rng(1)
    x = np.kron(rng.random((8, 8)) * 255, np.ones((16, 16)))
    for f in ALGORITHMS.values():
        a, b, far = (pack(f(v, 8)) & (1 << 64) - 1 for v in (x, x + rng.random(x.shape), rng.random(x.shape) * 255))
        assert bin(a ^ b).count("1") <= 8 < bin(a ^ far).count("1")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))
    if name in catalog.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(SF + "/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        res = con.execute(catalog.oracle_sql()[name])
        names = [x[0] for x in res.description]
        assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_combine_of_no_sets(spark):
    assert hamming.combine([], "any").count() == 0
    with pytest.raises(ValueError):
        hamming.combine([], "some")


def test_summary_of_a_score(spark):
    planted = spark.createDataFrame([("p", "o", "exact", 1), ("q", "o", "near", 2), ("s", "o", "near", 2)], "file string, original string, type string, expected_stage int")
    members = spark.createDataFrame([(1, "g", x) for x in "poq"], "stage int, group string, name string")
    removed = spark.createDataFrame([("p",), ("z",), ("y",), ("z",)], "name string")
    r = score.score_summary(planted, members, removed).first()
    assert (r.planted_total, r.caught, r.recall, r.caught_on_expected_stage) == (3, 2, 0.6667, 1)
    assert (r.removed_total, r.true_positive_removals, r.false_positive_removals, r.precision) == (3, 1, 2, 0.3333)
    assert (r.false_positive_examples, r.missed_examples) == ("y,z", "s")
    assert [(x.tier, x.file) for x in score.missed_by_tier(planted, members).collect()] == [("near", "s")]
    assert score.score_summary(planted, members, removed.where("false")).first().precision == 1.0
