"""All queries of the library's own operators, with the SQL that gives the same rows.

The driver's tables stand in for images: documents for files, embeddings for vectors and (by signs and differences of their
elements) for 64-bit codes, orders and lineitem for images and boxes, events for frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions.codes import infer_split, pack_bits, sign_code
from karst.operators import exact, hamming, leakage, resolve, score, vectors
from karst.operators.components import with_singletons
from karst.plans import cascade as plan
from karst.plans.config import Config
from karst.sources.images import fold_boxes
from karst.sources.shared import cut, read_table, spread

COSINE = 0.35
BITS = 18
TRAIN, EVALS = "src0", ["src1", "src2"]

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _keyed(spark, d):
    return exact.with_key(read_table(spark, d, "documents"), "doc_id", "text")


def _text_list(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_KEYS = "WITH k AS (SELECT doc_id AS item_id, sha256(text) AS key FROM documents), g AS (SELECT key, min(item_id) AS kept, count(*) AS n FROM k GROUP BY key) "


@_query(_KEYS + "SELECT g.key, kept, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS removed, 'sha256' AS reason FROM g JOIN k ON k.key = g.key AND item_id <> kept GROUP BY g.key, kept")
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(_keyed(spark, d)).select("key", "kept", _text_list("removed").alias("removed"), "reason")


@_query(_KEYS + "SELECT kept AS item_id FROM g")
def exact_survivors(spark, d):
    return exact.exact_survivors(_keyed(spark, d))


@_query(_KEYS + "SELECT item_id, kept, k.key, 'sha256' AS reason FROM k JOIN g ON k.key = g.key WHERE item_id <> kept")
def exact_removed(spark, d):
    return exact.exact_removed(_keyed(spark, d))


@_query(_KEYS + "SELECT sum(n)::BIGINT AS total_files, count(*) AS distinct_files, (sum(n) - count(*))::BIGINT AS exact_duplicate_files, round((sum(n) - count(*)) / sum(n), 4) AS exact_duplicate_fraction FROM g")
def profile_exact(spark, d):
    return exact.profile(_keyed(spark, d))


@_query(_KEYS + "SELECT n AS group_size, count(*) AS n_groups FROM g GROUP BY n")
def profile_histogram(spark, d):
    return exact.histogram(_keyed(spark, d))


def _codes(spark, d) -> DataFrame:
    """item_id, algo, code: signs of the elements, and signs of differences of neighbours (cyclic)."""
    e = spread(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"))
    turned = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    diff = pack_bits(F.zip_with(turned, F.col("embedding"), lambda a, b: a > b))
    rows = e.select("item_id", F.explode(F.array(F.struct(F.lit("phash").alias("algo"), sign_code("embedding").alias("code")), F.struct(F.lit("dhash").alias("algo"), diff.alias("code")))).alias("x"))
    return cut(rows.select("item_id", "x.algo", "x.code"), "codes")


def _half(lo: int, test: str) -> str:
    return f"list_sum(list_transform(range({lo}, {lo + 32}), lambda i: CASE WHEN {test} THEN 1::BIGINT << ({lo + 31} - i) ELSE 0 END))::BIGINT"


_SIGN, _DIFF = "embedding[i] > 0", "embedding[i % 64 + 1] > embedding[i]"
_CODES = f"WITH RECURSIVE c AS (SELECT vec_id, {_half(1, _SIGN)} AS h1, {_half(33, _SIGN)} AS l1, {_half(1, _DIFF)} AS h2, {_half(33, _DIFF)} AS l2 FROM embeddings), "


def _pairs_sql(k: int, t: int) -> str:
    return f"p{k} AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM c a JOIN c b ON a.vec_id < b.vec_id AND bit_count(xor(a.h{k}, b.h{k})) + bit_count(xor(a.l{k}, b.l{k})) <= {t})"


def _signs(spark, d):
    return _codes(spark, d).where("algo = 'phash'").select("item_id", "code")


_HAMMING = _CODES + _pairs_sql(1, BITS) + " SELECT src, dst FROM p1"


@_query(_HAMMING)
def hamming_bruteforce(spark, d):
    return hamming.brute_force(spread(_signs(spark, d)), BITS)


@_query(_HAMMING)
def hamming_multiindex(spark, d):
    return hamming.multi_index(_signs(spark, d), BITS)


@_query(_HAMMING)
def hamming_pivot(spark, d):
    return hamming.pivot(_signs(spark, d), BITS)


def _both(spark, d, mode, t):
    c = _codes(spark, d)
    algos = ["phash", "dhash"]
    if mode == "all":
        return hamming.pairs_on_all(c, algos, t)
    return hamming.combine([hamming.multi_index(c.where(F.col("algo") == a).select("item_id", "code"), t) for a in algos], mode)


@_query(_CODES + _pairs_sql(1, BITS) + ", " + _pairs_sql(2, BITS) + " SELECT src, dst FROM p1 UNION SELECT src, dst FROM p2")
def pairs_any(spark, d):
    return _both(spark, d, "any", BITS)


@_query(_CODES + _pairs_sql(1, 24) + ", " + _pairs_sql(2, 24) + " SELECT src, dst FROM p1 INTERSECT SELECT src, dst FROM p2")
def pairs_all(spark, d):
    return _both(spark, d, "all", 24)


def _components_sql(pairs: str, k: str = "", nodes: str = "SELECT vec_id AS item_id, vec_id AS seen FROM embeddings") -> str:
    return (
        f"s{k} AS (SELECT src, dst FROM {pairs} UNION SELECT dst, src FROM {pairs}), "
        f"r{k} AS ({nodes} UNION SELECT r{k}.item_id, s{k}.dst FROM r{k} JOIN s{k} ON r{k}.seen = s{k}.src), "
        f"cc{k} AS (SELECT item_id, min(seen) AS component FROM r{k} GROUP BY item_id) "
    )


def _vectors(spark, d):
    return spread(read_table(spark, d, "embeddings").select("vec_id", "embedding", "label"))


def _near(spark, d):
    return with_singletons(_vectors(spark, d).select(F.col("vec_id").alias("item_id")), hamming.linking_pairs(_signs(spark, d), BITS))


@_query(_CODES + _pairs_sql(1, BITS) + ", " + _components_sql("p1") + "SELECT item_id, component FROM cc")
def near_components(spark, d):
    return _near(spark, d)


@_query(_CODES + _pairs_sql(1, BITS) + ", " + _components_sql("p1") + "SELECT item_id FROM cc WHERE item_id = component")
def near_survivors(spark, d):
    return _near(spark, d).where("item_id = component").select("item_id")


_COS = "WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), "
_COS_P = _COS + f"p AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM n a JOIN n b ON a.vec_id < b.vec_id AND list_inner_product(a.e, b.e) >= {COSINE})"


def _cosine(spark, d):
    return vectors.range_join(_vectors(spark, d), COSINE)


@_query(_COS_P + " SELECT src, dst FROM p")
def cosine_pairs_flat(spark, d):
    return _cosine(spark, d)


@_query(_COS + "k AS (SELECT a.vec_id AS q, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS rank FROM n a JOIN n b ON a.vec_id <> b.vec_id) SELECT q, v, rank::INTEGER AS rank FROM k WHERE rank <= 5")
def cosine_knn(spark, d):
    return vectors.flat_knn(_vectors(spark, d), 6).where("q <> v").select("q", "v", (F.col("rank") - 1).cast("int").alias("rank"))


@_query()
def ivfflat_pairs(spark, d):
    """Approximate: neighbours of the 16 nearest of 32 cells. Its recall is tested at these settings."""
    return vectors.flagged_pairs(vectors.ivf_knn(_vectors(spark, d), 100, 32, 16), COSINE)


@_query()
def ivfpq_rerank(spark, d):
    """Approximate: product-quantised shortlist of 200 from the 24 nearest of 32 cells, exact re-ranking. Its recall is tested at these settings."""
    return vectors.pq_knn(_vectors(spark, d), 10, 32, 24, 8, 8, True, 200).select("q", "v", F.round("sim", 6).alias("sim"), "rank")


def _semantic(spark, d):
    return cut(with_singletons(_vectors(spark, d).select(F.col("vec_id").alias("item_id")), vectors.linking_pairs(_vectors(spark, d), COSINE)), "semantic")


_SEM = _COS_P + ", " + _components_sql("p")


@_query(_SEM + "SELECT item_id, component FROM cc")
def semantic_components(spark, d):
    return _semantic(spark, d)


@_query("SELECT o.o_orderkey AS image_id, o.o_custkey::VARCHAR AS partition_key, count(l.l_orderkey) AS num_boxes, count(DISTINCT l.l_suppkey) AS num_classes, coalesce(string_agg(DISTINCT l.l_suppkey::VARCHAR, ',' ORDER BY l.l_suppkey::VARCHAR), '') AS class_ids FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2")
def coco_fold(spark, d):
    # orders of a seventh are left out of the images, so their boxes dangle
    images = read_table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").cast("string").alias("partition_key"))
    boxes = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("category_id"))
    out = fold_boxes(images, boxes)
    return out.select("image_id", "partition_key", "num_boxes", "num_classes", F.array_join(F.array_sort(F.transform("class_ids", lambda x: x.cast("string"))), ",").alias("class_ids"))


def _annotations(spark, d, nested: bool = True) -> DataFrame:
    """Stand-in annotations of the vectors: nested class sets never conflict, single labels do."""
    classes = F.sequence(F.lit(0), F.col("label") % 3).cast("array<bigint>") if nested else F.array(F.col("label").cast("bigint"))
    return _vectors(spark, d).select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 7).alias("num_boxes"), (F.col("vec_id") * 37 % 101).alias("area"), classes.alias("class_ids")).withColumn("num_classes", F.size("class_ids").cast("long"))


def _members(spark, d, strategy, nested=True):
    e = _vectors(spark, d).select(F.col("vec_id").alias("item_id"), "embedding")
    return resolve.resolve(_semantic(spark, d), _annotations(spark, d, nested), strategy, e)


_ANN = _SEM.rstrip() + ", m AS (SELECT cc.item_id, component, item_id % 7 AS boxes, label % 3 + 1 AS classes, item_id * 37 % 101 AS area, label, count(*) OVER (PARTITION BY component) AS size FROM cc JOIN embeddings ON vec_id = item_id) "
_TIE = "item_id::VARCHAR || chr(1114111)"


def _first(order: str) -> str:
    return _ANN + f"SELECT item_id, component, row_number() OVER (PARTITION BY component ORDER BY {order}) = 1 AS kept FROM m"


@_query(_first(f"boxes DESC, classes DESC, {_TIE}"))
def resolve_most_annotated(spark, d):
    return _members(spark, d, "keep_most_annotated").select("item_id", "component", "kept")


@_query(_first(f"area DESC, {_TIE}"))
def resolve_highest_res(spark, d):
    return _members(spark, d, "keep_highest_res").select("item_id", "component", "kept")


_CENTRAL = _ANN.rstrip() + (
    ", e AS (SELECT m.item_id, component, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM m JOIN embeddings ON vec_id = m.item_id WHERE size > 1), "
    "x AS (SELECT component, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY component, i), "
    "centre AS (SELECT component, list(a ORDER BY i) AS u FROM x GROUP BY component), "
    "near AS (SELECT item_id, round(list_inner_product(v, u), 9) AS sim FROM e JOIN centre USING (component)) "
    f"SELECT item_id, component, row_number() OVER (PARTITION BY component ORDER BY sim DESC NULLS LAST, {_TIE}) = 1 AS kept FROM m LEFT JOIN near USING (item_id)"
)


@_query(_CENTRAL)
def resolve_central(spark, d):
    """Nearest to the cluster's mean vector, to nine places."""
    return _members(spark, d, "keep_central").select("item_id", "component", "kept")


@_query(_ANN + "SELECT item_id, component, CASE WHEN size > 1 THEN round(1.0::DOUBLE / size, 6) END AS weight FROM m")
def resolve_weighted(spark, d):
    return _members(spark, d, "weighted_sample").select("item_id", "component", "weight")


_APART = ", w AS (SELECT component, count(DISTINCT label) FILTER (boxes > 0) > 1 AS review FROM m GROUP BY component) "


@_query(
    _ANN.rstrip()
    + _APART
    + f"SELECT item_id, component, size, review OR row_number() OVER (PARTITION BY component ORDER BY boxes DESC, {_TIE}) = 1 AS kept, review, "
    + f"'keep_most_annotated' AS strategy, CASE WHEN review THEN '{resolve.REVIEW_NOTE}' ELSE '' END AS note FROM m JOIN w USING (component) WHERE size > 1"
)
def cluster_records(spark, d):
    """The members of each cluster as stage 4 writes them; single labels, so clusters of two labels are for review."""
    return resolve.cluster_records(_members(spark, d, "keep_most_annotated", False), "keep_most_annotated").drop("weight")


@_query(_ANN + "SELECT component FROM m WHERE boxes > 0 GROUP BY component HAVING count(DISTINCT label) > 1")
def review_clusters(spark, d):
    return resolve.conflicts(_semantic(spark, d), _annotations(spark, d, False))


def _paths(spark, d):
    docs = read_table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("item_id"), infer_split(path, [TRAIN, *EVALS]).alias("split"), F.col("lang").alias("partition_key"), "text")


_SPLIT = "WITH i AS (SELECT doc_id AS item_id, CASE WHEN contains(lower(source || '/' || lang || '/' || doc_id), 'src0') THEN 'src0' WHEN contains(lower(source || '/' || lang || '/' || doc_id), 'src1') THEN 'src1' WHEN contains(lower(source || '/' || lang || '/' || doc_id), 'src2') THEN 'src2' END AS split, lang AS partition_key, sha256(text) AS key FROM documents) "


@_query(_SPLIT + "SELECT item_id, split FROM i")
def split_inference(spark, d):
    return _paths(spark, d).select("item_id", "split")


_LEAK = _SPLIT.rstrip() + ", g AS (SELECT key, min(item_id) AS kept FROM i GROUP BY key), e AS (SELECT kept AS src, item_id AS dst FROM i JOIN g USING (key) WHERE kept <> item_id), s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l AS (SELECT item_id, split, EXISTS (SELECT 1 FROM s JOIN i t ON t.item_id = s.dst AND t.split = 'src0' WHERE s.src = i.item_id) AS leaked FROM i WHERE split IN ('src1', 'src2')), r AS (SELECT *, row_number() OVER (PARTITION BY split, leaked ORDER BY item_id) AS k FROM l) "


@_query(_LEAK + "SELECT split, count(*) AS eval_images, count(*) FILTER (leaked) AS leaked_images, round(count(*) FILTER (leaked) / count(*), 4) AS leaked_fraction, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (leaked AND k <= 10), '') AS examples FROM r GROUP BY split")
def leakage_by_split(spark, d):
    items = _paths(spark, d)
    removed = exact.exact_removed(exact.with_key(items, "item_id", "text"))
    return leakage.leakage_by_split(items.select("item_id", "split"), removed.select(F.col("kept").alias("src"), F.col("item_id").alias("dst")), TRAIN, EVALS)


@_query(_SPLIT + "SELECT partition_key AS partition, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM i WHERE split IS NOT NULL GROUP BY partition_key HAVING bool_or(split = 'src0') AND bool_or(split IN ('src1', 'src2'))")
def partition_violations(spark, d):
    return leakage.partition_violations(_paths(spark, d), TRAIN, EVALS)


@_query(_SPLIT.rstrip() + ", g AS (SELECT key, min(item_id) AS kept FROM i GROUP BY key), t AS (SELECT i.item_id, split, item_id = kept AS stays FROM i LEFT JOIN g USING (key)) SELECT count(*) FILTER (split = 'src0') AS n_train_raw, count(*) FILTER (split = 'src0' AND coalesce(stays, true)) AS n_train_reduced, count(*) FILTER (split IN ('src1', 'src2')) AS n_test FROM t")
def train_twice_counts(spark, d):
    items = _paths(spark, d)
    removed = exact.exact_removed(exact.with_key(items, "item_id", "text"))
    return leakage.train_twice_counts(leakage.train_twice_sets(items.select("item_id", "split"), removed, TRAIN, EVALS))


@_query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 5 = 0")
def frame_subsample(spark, d):
    return resolve.every_kth(read_table(spark, d, "events").select("event_id", "user_id", "ts"), 5, "user_id", ["ts", "event_id"]).select("event_id", "user_id")


_METRICS = _KEYS + ", s1 AS (SELECT 1 AS stage, sum(n)::BIGINT AS items_in, (sum(n) - count(*))::BIGINT AS items_removed FROM g), s2 AS (SELECT 2 AS stage, count(*) AS items_in, count(*) FILTER (kept % 9 = 0) AS items_removed FROM g), m AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2) "


def _metrics(spark, d):
    k = _keyed(spark, d)
    keep = exact.exact_keepers(k)
    one = keep.agg(F.sum("n").alias("items_in"), (F.sum("n") - F.count("*")).alias("items_removed")).withColumn("stage", F.lit(1))
    two = keep.agg(F.count("*").alias("items_in"), F.count_if(F.col("kept") % 9 == 0).alias("items_removed")).withColumn("stage", F.lit(2))
    return one.unionByName(two)


@_query(_METRICS + "SELECT min_by(items_in, stage) AS initial_images, max_by(items_in - items_removed, stage) AS final_images, min_by(items_in, stage) - max_by(items_in - items_removed, stage) AS removed, round((min_by(items_in, stage) - max_by(items_in - items_removed, stage)) / min_by(items_in, stage), 4) AS reduction_fraction FROM m")
def removal_report(spark, d):
    return score.report(_metrics(spark, d))[0]


@_query(_METRICS + "SELECT stage, items_in, items_removed, items_in - items_removed AS items_out, round(items_removed / (SELECT items_in FROM s1), 4) AS fraction_of_initial FROM m")
def stage_report(spark, d):
    return score.report(_metrics(spark, d))[1]


_FULL = (
    ", t AS (SELECT min_by(items_in, stage) AS initial_images, max_by(items_in - items_removed, stage) AS final_images FROM m) "
    "SELECT stage, items_in, items_removed, items_in - items_removed AS items_out, round(items_removed / initial_images, 4) AS fraction_of_initial, "
    "CASE stage WHEN 1 THEN 'exact (SHA-256)' ELSE 'near-duplicate (perceptual)' END AS label, stage / 2 AS seconds, 100.0::DOUBLE AS peak_mem_mb, "
    "initial_images, final_images, initial_images - final_images AS removed, round((initial_images - final_images) / initial_images, 4) AS reduction_fraction, "
    "'flat' AS index_type, NULL::VARCHAR AS leakage FROM m, t"
)


@_query(_METRICS.rstrip() + _FULL)
def report_full(spark, d):
    extra = {"seconds": F.col("stage") / 2, "peak_mem_mb": F.lit(100.0), "extra": F.create_map(F.lit("index_type"), F.lit("flat"))}
    return score.report_full(_metrics(spark, d).withColumns(extra)).drop("extra")


# planted pairs: every removed exact copy (tier exact) and every eleventh document with its successor (tier near, never caught)
_PLANT = _KEYS + ", pl AS (SELECT item_id AS file, kept AS original, 'exact' AS type FROM k JOIN g USING (key) WHERE item_id <> kept UNION ALL SELECT item_id, item_id + 1, 'near' FROM k WHERE item_id % 11 = 0), c AS (SELECT pl.*, (SELECT a.key = b.key FROM k a, k b WHERE a.item_id = file AND b.item_id = original) AS hit FROM pl) "


def _plant(spark, d):
    k = _keyed(spark, d)
    e = exact.exact_removed(k).select(F.col("item_id").alias("file"), F.col("kept").alias("original"), F.lit("exact").alias("type"), F.lit(1).alias("expected_stage"))
    n = k.where("item_id % 11 = 0").select(F.col("item_id").alias("file"), (F.col("item_id") + 1).alias("original"), F.lit("near").alias("type"), F.lit(2).alias("expected_stage"))
    members = k.join(exact.exact_keepers(k).where("n > 1"), "key").select(F.lit(1).alias("stage"), F.col("key").alias("group"), F.col("item_id").alias("name"))
    return e.unionByName(n), members, exact.exact_removed(k).select(F.col("item_id").alias("name"))


@_query(_PLANT + "SELECT type AS tier, count(*) AS total, count(*) FILTER (hit) AS caught, count(*) FILTER (hit) AS on_time, count(*) - count(*) FILTER (hit) AS missed, round(count(*) FILTER (hit) / count(*), 4) AS recall FROM c GROUP BY type")
def plant_score(spark, d):
    planted, members, _ = _plant(spark, d)
    return score.recall_by_tier(planted, members)


@_query(_PLANT + "SELECT count(*) AS removed, count(*) AS related, 1.0::DOUBLE AS precision FROM k JOIN g USING (key) WHERE item_id <> kept")
def plant_precision(spark, d):
    planted, _, removed = _plant(spark, d)
    return score.precision(planted, removed)


_SUMMARY = (
    ", x AS (SELECT DISTINCT item_id AS name FROM k JOIN g USING (key) WHERE item_id <> kept AND item_id % 3 <> 0 UNION SELECT DISTINCT kept FROM g WHERE kept % 13 = 0), "
    "f AS (SELECT name FROM x WHERE name NOT IN (SELECT file FROM pl UNION SELECT original FROM pl)), "
    "lost AS (SELECT file FROM c WHERE hit IS NOT TRUE ORDER BY file::VARCHAR LIMIT 10), few AS (SELECT name FROM f ORDER BY name::VARCHAR LIMIT 10) "
    "SELECT (SELECT count(*) FROM c) AS planted_total, (SELECT count(*) FILTER (hit) FROM c) AS caught, (SELECT round(count(*) FILTER (hit) / count(*), 4) FROM c) AS recall, "
    "(SELECT count(*) FILTER (hit AND type = 'exact') FROM c) AS caught_on_expected_stage, (SELECT count(*) FROM x) AS removed_total, "
    "(SELECT count(*) FROM x) - (SELECT count(*) FROM f) AS true_positive_removals, (SELECT count(*) FROM f) AS false_positive_removals, "
    "round(1 - (SELECT count(*) FROM f) / (SELECT count(*) FROM x), 4) AS precision, "
    "(SELECT coalesce(string_agg(name::VARCHAR, ',' ORDER BY name::VARCHAR), '') FROM few) AS false_positive_examples, "
    "(SELECT coalesce(string_agg(file::VARCHAR, ',' ORDER BY file::VARCHAR), '') FROM lost) AS missed_examples"
)


@_query(_PLANT.rstrip() + _SUMMARY)
def score_summary(spark, d):
    """Two thirds of the copies are removed, and every keeper whose id is divisible by 13."""
    planted, members, removed = _plant(spark, d)
    wrong = exact.exact_keepers(_keyed(spark, d)).where("kept % 13 = 0").select(F.col("kept").alias("name"))
    return score.score_summary(planted, members, removed.where("name % 3 <> 0").union(wrong))


_ANY = " OR ".join(f"bit_count(xor(a.h{k}, b.h{k})) + bit_count(xor(a.l{k}, b.l{k})) <= {BITS}" for k in (1, 2))
_CASCADE = (
    _CODES
    + "i AS (SELECT vec_id AS item_id, CASE WHEN vec_id % 20 = 19 THEN vec_id - 1 ELSE vec_id END AS content FROM embeddings), "
    + "one AS (SELECT min(item_id) AS item_id FROM i GROUP BY content), c1 AS (SELECT c.* FROM c JOIN one ON item_id = vec_id), "
    + f"p2 AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM c1 a JOIN c1 b ON a.vec_id < b.vec_id AND ({_ANY})), "
    + _components_sql("p2", "2", "SELECT item_id, item_id AS seen FROM one").rstrip()
    + ", e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings JOIN cc2 ON vec_id = item_id WHERE item_id = component), "
    + "n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM e), "
    + "k AS (SELECT a.vec_id AS q, b.vec_id AS v, list_inner_product(a.e, b.e) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS place FROM n a, n b), "
    + f"p3 AS (SELECT least(q, v) AS src, greatest(q, v) AS dst FROM k WHERE q <> v AND place <= 100 AND sim >= {COSINE}), pp AS (SELECT * FROM p2 UNION SELECT * FROM p3), "
    + _components_sql("pp", "4", "SELECT item_id, item_id AS seen FROM one").rstrip()
    + f", m AS (SELECT item_id, row_number() OVER (PARTITION BY component ORDER BY item_id % 7 DESC, label % 3 DESC, {_TIE}) = 1 AS kept FROM cc4 JOIN embeddings ON vec_id = item_id) "
    + "SELECT i.item_id, CASE WHEN m.item_id IS NULL THEN 1 WHEN NOT kept THEN 4 END AS removed_stage FROM i LEFT JOIN m ON m.item_id = i.item_id"
)


@_query(_CASCADE)
def cascade(spark, d):
    """All four stages over the vectors; every twentieth item is a byte copy of the one before it."""
    v = _vectors(spark, d)
    items = v.select(F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 20 == 19, F.col("vec_id") - 1).otherwise(F.col("vec_id")).cast("string").alias("content"))
    cfg = Config()
    cfg.stage2.hamming_threshold, cfg.stage3.cosine_threshold = BITS, COSINE
    e = v.select(F.col("vec_id").alias("item_id"), "embedding")
    return plan.run(items, _codes(spark, d), e, _annotations(spark, d), cfg)[1]


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
