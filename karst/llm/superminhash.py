"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and components.

A text's set is its distinct lower-cased 5-word shingles (fewer words: the whole sequence; none: empty). Element e puts the
value j + r(e, j), r in [0, 1), at signature place p(e, j), p(e, .) a permutation of the places; each place keeps the least
value. Values of step j + 1 exceed all of step j, so a text stops as soon as all places hold a value of the steps done.
Ranks of an element are a permutation, which lowers the variance of the estimate against independent hashes.

Texts with equal sets are one unit. Units that share a band of 5 places meet in a bucket. Each bucket first compares its
members with one centre of its own; the confirmed links give provisional groups. Only where a bucket still holds more than
one group are the members outside its largest group compared with the rest, so that a group of thousands of copies costs
a few comparisons a copy: first with a few of the bucket's main group. What is then still open is settled around the bucket's
centre, by what each set shares with it and what it has besides, which rules out nearly all pairs without making them. Pairs
go by size, by signature estimate (5 standard deviations below the threshold), then by the full sets.

A linked pair at the threshold is missed with a probability below 1e-6 (bands and estimate), and less for closer ones.

Edge cases: null and empty texts have an empty set, link with nothing and are kept; a null doc_id links with nothing, has a
null component and is kept; rows that repeat a doc_id are judged by their own texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.arrowtext import COEF, SLICE, Texts, U, batch, gram_hashes, mix, slices
from karst.operators.components import connected_components
from karst.sources.shared import cut, drop_cut, free_shuffles, own_names, spread, text_hash

SHINGLE = 5
PERCENT = 80
PLACES = 256
ROWS = 5
BANDS = 25
REPS = 250_000  # units whose texts are found by a broadcast of three numbers each, under 40 MB; more of them by a shuffle
_STEP = 24  # bits of r; a value is step << 24 | r


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and bounds."""
    t.split()
    h = t.word_hashes()
    at, g = gram_hashes(h, t.wd, SHINGLE)
    owner = t.wd[at]
    few = np.flatnonzero((t.nw > 0) & (t.nw < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for i, d in enumerate(few):
            w = h[t.wc[d] : t.wc[d + 1]]
            short[i] = (w * COEF[16 : 16 + len(w)]).sum() + U(len(w))
        where = np.searchsorted(owner, few)
        g, owner = np.insert(g, where, mix(short)), np.insert(owner, where, few)
    bound = np.searchsorted(owner, np.arange(t.n + 1))
    for a, z in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        g[a:z].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[keep], np.searchsorted(owner[keep], np.arange(t.n + 1))


def signatures(g: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One row of PLACES unsigned 32-bit values per set."""
    n = len(bound) - 1
    sig = np.full((n, PLACES), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(bound))
    base = doc * PLACES
    x = mix(g ^ U(0x5851F42D4C957F2D))
    a1, b1, a2, b2, a3, b3 = (((x >> U(s)) & U(0xFF)).astype(np.uint8) for s in (0, 8, 16, 24, 32, 40))
    a1, a2, a3 = a1 | np.uint8(1), a2 | np.uint8(1), a3 | np.uint8(1)
    low = np.uint8(PLACES - 1)
    for j in range(PLACES):
        if not len(g):
            break
        p = (np.uint8(j) * a1 + b1) & low
        p ^= p >> np.uint8(3)
        p = (p * a2 + b2) & low
        p ^= p >> np.uint8(4)
        p = (p * a3 + b3) & low
        r = (mix(g + U(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - _STEP)).astype(np.uint32)
        np.minimum.at(flat, base + p, r | np.uint32(j << _STEP))
        live = np.unique(doc) if j else np.flatnonzero(np.diff(bound) > 0)
        done = live[sig[live].max(axis=1) < np.uint32(min((j + 1) << _STEP, 0xFFFFFFFF))]
        if len(done):
            mask = np.zeros(n, bool)
            mask[done] = True
            on = ~mask[doc]
            g, doc, base, a1, b1, a2, b2, a3, b3 = (v[on] for v in (g, doc, base, a1, b1, a2, b2, a3, b3))
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys per row."""
    s = sig[:, : BANDS * ROWS].astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    return mix((s * COEF[:ROWS]).sum(axis=2) + COEF[32 : 32 + BANDS])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, u (the set's 64-bit name, null if empty), bands, sig (a byte of each place)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("u", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for s in slices(batches, most=SLICE // 2):
            g, bound = shingle_sets(Texts(s.column("text"), lower=True))
            size = np.diff(bound)
            sig = signatures(g, bound)
            n = len(sig)
            names, empty = unit_names(g, bound), size == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sig).view(np.int64).reshape(-1)))
            low = (sig & np.uint32(255)).astype(np.uint8)
            blob = pa.Array.from_buffers(pa.binary(PLACES), n, [None, pa.py_buffer(low.tobytes())]).cast(pa.binary()) if n else pa.array([], pa.binary())
            yield batch(schema, s.column("doc_id").cast(pa.int64()), s.column("th"), size.astype(np.int64), pa.array(names, mask=empty), bands, blob)

    return spread(docs).select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, u long, bands array<long>, sig binary")


def unit_names(g: np.ndarray, bound: np.ndarray) -> np.ndarray:
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g ^ U(0xD6E8FEB86659FD93)), out=total[1:])
    return mix(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(np.uint64) * U(0xA0761D6478BD642F)).view(np.int64)


def _likely(pairs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and signatures do not rule out. Bytes of places that differ agree by chance, which only adds pairs."""
    a, b = units.select(F.col("u").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx")), units.select(F.col("u").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy"))
    j = percent / 100
    least = int(PLACES * (j - 5 * (j * (1 - j) / PLACES) ** 0.5))

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                s, t = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sx", "sy"))
                yield pa.RecordBatch.from_arrays([rb.column("x"), rb.column("y")], ["x", "y"]).filter(pa.array((s == t).sum(axis=1) >= least))

    rows = pairs.join(a, "x").join(b, "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    return rows.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a, b = texts.select(F.col("u").alias("x"), F.col("text").alias("tx")), texts.select(F.col("u").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        for s in slices(batches, "tx"):
            g, gb = shingle_sets(Texts(s.column("tx"), lower=True))
            h, hb = shingle_sets(Texts(s.column("ty"), lower=True))
            ok = np.zeros(s.num_rows, bool)
            for i in range(s.num_rows):
                p, q = g[gb[i] : gb[i + 1]], h[hb[i] : hb[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= percent * (len(p) + len(q) - inter)
            yield pa.RecordBatch.from_arrays([s.column("x"), s.column("y")], ["x", "y"]).filter(pa.array(ok))

    return pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def _texts(docs: DataFrame, units: DataFrame, members: DataFrame) -> DataFrame:
    """u, text of every unit that shares a band with another, by the document and text hash that stand for it."""
    rep = cut(units.join(members.select("u").distinct(), "u", "left_semi").select("u", "doc_id", "th"), "near-reps")
    if rep.count() <= REPS:
        rep = F.broadcast(rep)
    found = docs.select("doc_id", text_hash().alias("th"), "text").join(rep, ["doc_id", "th"]).select("u", "text")
    return cut(found.dropDuplicates(["u"]), "near-texts")


def _possible(m: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """x, y: pairs of different groups around one centre that could reach the threshold. m: c (centre), u, g.

    With i = |u & c| and the rest of u, |x & y| is at most min(ix, iy) plus the elements outside c that both have. So a pair
    either passes by its four sizes alone, or shares a rest element; of those, each unit shows only its rarest, as many as
    must contain a shared one if the pair is linked (prefix filter)."""
    a, b = texts.select(F.col("u").alias("c"), F.col("text").alias("tc")), texts.select("u", F.col("text").alias("tu"))

    def run(batches):
        for s in slices(batches, "tu"):
            g, gb = shingle_sets(Texts(s.column("tc"), lower=True))
            h, hb = shingle_sets(Texts(s.column("tu"), lower=True))
            rest, size = [], np.zeros(s.num_rows, np.int64)
            for i in range(s.num_rows):
                p, q = g[gb[i] : gb[i + 1]], h[hb[i] : hb[i + 1]]
                at = np.minimum(np.searchsorted(p, q), max(len(p) - 1, 0))
                r = q[p[at] != q] if len(p) else q
                size[i] = len(q)
                rest.append(r.view(np.int64))
            yield pa.RecordBatch.from_arrays([s.column("c"), s.column("u"), s.column("g"), pa.array(size), pa.array(size - np.array([len(r) for r in rest], np.int64)), pa.array(rest, pa.list_(pa.int64()))], ["c", "u", "g", "n", "i", "rest"])

    around = cut(m.join(a, "c").join(b, "u").select("c", "u", "g", "tc", "tu").mapInArrow(run, "c long, u long, g long, n long, i long, rest array<long>"), "near-around")
    # the reference grows by what many members have besides: the bounds hold for any reference set
    every = around.groupBy("c").agg(F.count("*").alias("m"))
    e = around.select("c", "u", F.explode("rest").alias("e"))
    often = e.groupBy("c", "e").agg(F.count("*").alias("count")).join(every, "c")
    shared = (F.col("count") >= 10) & (F.col("count") * 20 >= F.col("m"))
    e = cut(e.join(often, ["c", "e"]).select("c", "u", "e", "count", shared.alias("shared")), "near-rest")
    more = e.where("shared").groupBy("c", "u").agg(F.count("*").alias("more"))
    around = around.drop("rest").join(more, ["c", "u"], "left").withColumn("i", F.col("i") + F.coalesce("more", F.lit(0))).drop("more")
    around = cut(around, "near-around")
    side = lambda df, k: df.select("c", *[F.col(v).alias(f"{v}{k}") for v in ("u", "g", "n", "i")])
    main = around.groupBy("c", "g").count().groupBy("c").agg(F.max_by("g", F.struct("count", "g")).alias("main"))
    least = F.least("i1", "i2")
    sizes = (F.col("g1") != F.col("g2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    enough = least * 100 >= (F.col("n1") + F.col("n2") - least) * percent
    with_main = around.join(main, "c")
    one = side(with_main.where("g <> main"), 1).join(side(around, 2), "c").where(sizes & enough).select(F.col("u1").alias("x"), F.col("u2").alias("y"))

    need = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100).cast("long") - F.col("i"))
    show = F.col("n") - F.col("i") - need + 1
    e = e.where("not shared").join(around.withColumn("show", show).where("show > 0"), ["c", "u"])
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("c", "u").orderBy("count", "e"))).where((F.col("r") <= F.col("show")) & (F.col("count") > 1))
    e = cut(e.select("c", "e", "u", "g", "n", "i"), "near-shown")
    keyed = lambda k: e.select("c", "e", *[F.col(v).alias(f"{v}{k}") for v in ("u", "g", "n", "i")])
    most = F.least("i1", "i2") + F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2"))
    could = most * 100 >= (F.col("n1") + F.col("n2") - most) * percent
    two = keyed(1).join(keyed(2), ["c", "e"]).where((F.col("u1") < F.col("u2")) & sizes & could).select(F.col("u1").alias("x"), F.col("u2").alias("y"))
    return one.unionByName(two)


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """b, u, g, main, centre: members of the buckets that hold more than one provisional group. main is the largest of them,
    centre the unit of the whole main group with the most links, which lies near the middle of a family of copies."""
    groups = cut(connected_components(links, "x", "y").withColumnRenamed("node", "u"), "near-groups")
    degree = links.select(F.col("x").alias("u")).union(links.select("y")).groupBy("u").count()
    middle = groups.join(degree, "u").groupBy("component").agg(F.max_by("u", F.struct("count", "u")).alias("middle"))
    m = members.join(groups, "u", "left").select("b", "u", F.coalesce("component", "u").alias("g"))
    by = m.groupBy("b", "g").count().groupBy("b").agg(F.max_by("g", F.struct("count", "g")).alias("main"), F.count("*").alias("k")).where("k > 1").select("b", "main")
    by = by.join(middle, by.main == middle.component, "left").select("b", "main", F.coalesce("middle", "main").alias("centre"))
    return cut(m.join(by, "b"), "near-open")


def near_links(docs: DataFrame, rows: DataFrame, percent: int = PERCENT, turns: int = 1, centres: int = 4) -> DataFrame:
    """x, y: confirmed links between units that join every linked group (not all pairs of it)."""
    spark = docs.sparkSession
    rows = rows.where("u is not null and doc_id is not null")
    units = cut(rows.select("u", "doc_id", "th", F.col("n_shingles").alias("n"), "bands", "sig").dropDuplicates(["u"]), "near-units")
    bands = units.select("u", F.explode("bands").alias("b"))
    buckets = bands.groupBy("b").agg(F.min(F.struct(F.xxhash64("u").alias("p"), "u")).alias("c"), F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(buckets, "b").select("b", "u", F.col("c.u").alias("centre")), "near-members")
    texts = _texts(docs, units, members)
    free_shuffles(spark)

    def test(pairs: DataFrame) -> None:
        """Confirm pairs that no earlier turn has tested and add the links."""
        nonlocal tested, links
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        some = cut(_likely(pairs, units, percent), "near-pairs")
        found = cut(_confirm(some, texts, percent), "near-links")
        tested = some if tested is None else tested.unionByName(some)
        links = found if links is None else links.unionByName(found)
        free_shuffles(spark)

    tested = links = None
    # every bucket against its centre, then what is outside a bucket's main group against a few of that group
    test(members.where("u <> centre").select(F.col("centre").alias("x"), F.col("u").alias("y")))
    m = _open(members, links)
    for turn in range(turns):
        if not m.limit(1).count():
            break
        at = m.where("g = main").groupBy("b").agg(*[F.min_by("u", F.xxhash64("u", F.lit(turn * centres + i))).alias(f"c{i}") for i in range(centres)])
        pairs = m.where("g <> main").select("b", F.col("u").alias("x")).join(at, "b")
        test(pairs.select("x", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(centres)]))).alias("y")))
        m = _open(members, links)

    if m.limit(1).count():
        around = m.select(F.col("centre").alias("c"), "u", "g").union(m.select("centre", "centre", "main")).distinct()
        test(_possible(around, texts, percent))
    for used in (units, members, texts):
        drop_cut(used)
    return links


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept for every row of docs."""
    docs = spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = cut(sketch(docs), "near-rows")
    links = near_links(docs, rows, percent)
    cc = connected_components(links, "x", "y").withColumnRenamed("node", "u")
    rows = rows.select("doc_id", "th", "n_shingles", "u").join(cut(cc, "near-cc"), "u", "left").withColumn("c", F.coalesce("component", "u"))
    named = rows.where("c is not null and doc_id is not null")
    least = cut(named.groupBy("c").agg(F.min("doc_id").alias("m")), "near-least")
    linked = named.join(least, "c").select("doc_id", "th", "n_shingles", F.col("m").alias("component_id"))
    alone = rows.where("c is null or doc_id is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@own_names
def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, the smallest doc_id, and with one of rows that repeat a doc_id and its text."""
    groups = cut(near_groups(docs, percent).select("doc_id", "th", "kept"), "near-decisions")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    d = docs.withColumn("_th", text_hash())
    out = d.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti")
    if groups.where("kept and doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        out = out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id", "_th"]))
    return out.select(docs.columns)
