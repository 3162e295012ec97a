"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Symbols: the `head` most frequent tokens, and for all others 2-byte-suffix classes. Context vectors of the two preceding
symbols (one table per place) add up to a prediction r; a symbol w has the log-score r . q_w + b_w. Training is numpy AdaGrad on
noise-contrastive estimation: every partition of the training texts trains on all of its tokens (so what is gathered grows
with the corpus), and parameters are averaged over the partitions, weighted by tokens, in `rounds` rounds.
Scoring normalises: for the distinct contexts of a batch, one matrix product gives the scores of all symbols, and a
log-sum-exp their normaliser; a token outside the head has its class's probability times its own share in the class,
(c + 0.1) / (sum of c + 0.1 over the class + 0.1 for an unseen one), so the probabilities of all words add up to one.

Counts are exact over all training tokens. The `known` most frequent tokens' counts (a fixed number) are broadcast as a hash
table; rarer tokens of a text leave the scan as (text, token, number) rows and meet the counts in a shuffled join.
Tokens are told apart by 64-bit hashes.

Edge cases: null and empty texts are one end token; a null doc_id counts as the empty string in the hold-out rule's place and
is trained on; rows that repeat a doc_id with the same text get equal rows; without training rows every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import SLICE, HashTable, Texts, U, batch, mix, release, slices
from karst.sources.shared import cut, free_shuffles, spread, text_hash

HEAD = 1024
CLASSES = 128
KNOWN = 200_000
DIM = 24
NOISE = 8
ROUNDS = 1
END_HASH = np.int64(mix(np.array([0x1234567], np.uint64)).view(np.int64)[0])
_LN10 = float(np.log(10.0))


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, the end after each text included, and the bounds of texts."""
    t.split()
    h = t.word_hashes()
    b = t.buf
    two = b[t.we - 1].astype(np.uint32) | b[np.maximum(t.we - 2, 0)].astype(np.uint32) << np.uint32(8)
    cls = (two * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CLASSES)
    hs = np.insert(h, t.wc[1:], U(END_HASH.view(np.uint64)))
    cs = np.insert(cls.astype(np.int16), t.wc[1:], 0)
    return hs, cs, t.wc + np.arange(t.n + 1)


def training_rows() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, cls, c of every distinct token."""
    schema = pa.schema([("h", pa.int64()), ("cls", pa.int16()), ("c", pa.int64())])

    def run(batches):
        held, size = [], 0

        def flush():
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            return batch(schema, u.view(np.int64), c[first], np.bincount(inv, n).astype(np.int64))

        for s in slices(batches):
            h, c, _ = tokens(Texts(s.column("text"), lower=True))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, c[first], n))
            size += len(u)
            if size > 1_500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        release()

    rows = docs.select("text").mapInArrow(run, "h long, cls short, c long")
    return rows.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c"))


def most_frequent(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The at most `most` tokens of the largest counts, by a threshold from the histogram of counts."""
    logs = vocab.groupBy(F.when(F.col("c") < 4096, F.col("c")).otherwise(F.lit(4096)).alias("k")).count().collect()  # at most 4096 rows
    total, least = 0, 4097
    for r in sorted(logs, key=lambda r: -r.k):
        if total + r["count"] > most and r.k < 4096:
            break
        total, least = total + r["count"], r.k
    got = vocab.where(F.col("c") >= least)
    if total > most:  # so many very frequent tokens: the largest by an ordered limit
        got = got.orderBy(F.desc("c"), "h").limit(most)
    got = got.toArrow()
    h, c, k = (got.column(x).to_numpy() for x in ("h", "c", "cls"))
    order = np.lexsort((h, -c))
    return h[order], c[order], k[order]


class Symbols:
    """Tokens to symbol numbers: the head's first, then the classes."""

    def __init__(self, heads: np.ndarray):
        self.table = HashTable(12)
        self.table.add(heads.view(np.uint64))
        self.n_head = len(heads)
        self.n = self.n_head + CLASSES

    def of(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at = self.table.find(h)
        return np.where(at >= 0, at, self.n_head + cls).astype(np.int32)


def contexts(sym: np.ndarray, bound: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each; before a text stands the symbol `start`."""
    one, two = np.empty_like(sym), np.empty_like(sym)
    one[1:], two[2:] = sym[:-1], sym[:-2]
    first = bound[:-1]
    one[first] = two[first] = start
    two[np.minimum(first + 1, len(sym) - 1)] = start
    return one, two


def train_nce(sym, one, two, params: dict, state: dict, noise: np.ndarray, rng, k: int = NOISE, rate: float = 0.1, step: int = 512) -> None:
    """AdaGrad on binary decisions between the token and k draws of noise; params (r1, r2, and qb: q with b as its last column) and
    state are changed in place."""
    r1, r2, qb = params["r1"], params["r2"], params["qb"]
    dim = r1.shape[1]
    small = np.int16 if len(r1) < 1 << 15 else np.int32  # 16 bits are sorted by radix
    sym, one, two = (x.astype(small) for x in (sym, one, two))
    cum = np.cumsum(noise)
    log_kp = np.log(noise * k + 1e-12).astype(np.float32)
    starts = range(0, len(sym), step)
    sizes = [max(min(step, len(sym) - a) // 4, 8) for a in starts]
    draws = np.searchsorted(cum, rng.random(sum(sizes)) * cum[-1]).astype(small)
    p = np.ones((step, dim + 1), np.float32)
    at = 0
    with np.errstate(over="ignore"):  # exp of a large score is infinite and its share 0
        for a, m in zip(starts, sizes, strict=True):
            w, x, y = sym[a : a + step], one[a : a + step], two[a : a + step]
            draw = draws[at : at + m]  # m draws for the step's tokens together
            at += m
            p = p[: len(w)]
            np.add(r1.take(x, axis=0), r2.take(y, axis=0), out=p[:, :dim])
            qw, qd = qb.take(w, axis=0), qb.take(draw, axis=0)
            e_true = np.einsum("ij,ij->i", p, qw)
            e_true -= log_kp[w]
            e_true = (-1.0 / (1.0 + np.exp(e_true)))[:, None]
            against = -qd
            against[:, dim] += log_kp[draw]
            e_noise = p @ against.T
            np.exp(e_noise, out=e_noise)
            e_noise += np.float32(1)
            np.divide(np.float32(k / m), e_noise, out=e_noise)
            gp = e_noise @ qd[:, :dim]
            gp += e_true * qw[:, :dim]
            _update(r1, state["r1"], x, gp, rate)
            _update(r2, state["r2"], y, gp, rate)
            _update(qb, state["qb"], np.concatenate([w, draw]), np.concatenate([e_true * p, e_noise.T @ p]), rate)


def _update(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An AdaGrad step by the gradients' sums over equal rows."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.ones(len(r), bool)
    np.not_equal(r[1:], r[:-1], out=first[1:])
    at = np.flatnonzero(first)
    g = np.add.reduceat(grad.take(order, axis=0), at, axis=0)
    r = r[at]
    s = seen.take(r, axis=0)
    s += g * g
    seen[r] = s
    g *= np.float32(rate)
    g /= np.sqrt(s, out=s)
    table[r] -= g


def new_params(n: int, noise: np.ndarray, dim: int = DIM, seed: int = 5) -> dict:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda: (0.1 * rng.standard_normal((n + 1, dim))).astype(np.float32)
    return {"r1": draw(), "r2": draw(), "q": draw(), "b": np.log(np.append(noise, 1e-9) + 1e-9).astype(np.float32)}


def train(docs: DataFrame, heads: np.ndarray, noise: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Averaged parameters. They are summed on executors by row; the driver gets one model."""
    spark = docs.sparkSession
    n = len(noise)
    params = new_params(n, noise)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((heads, noise, params))
        schema = pa.schema([("row", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])

        def run(batches, shared=shared, turn=turn):
            heads, noise, params = shared.value
            p = {"r1": params["r1"].copy(), "r2": params["r2"].copy(), "qb": np.column_stack([params["q"], params["b"]])}
            state = {k: np.ones_like(v) for k, v in p.items()}
            symbols, seen = Symbols(heads), 0
            rng = np.random.Generator(np.random.PCG64(7 + turn))
            for s in slices(batches):
                h, c, bound = tokens(Texts(s.column("text"), lower=True))
                sym = symbols.of(h, c)
                one, two = contexts(sym, bound, n)
                at = rng.permutation(len(sym))
                train_nce(sym[at], one[at], two[at], p, state, noise, rng)
                seen += len(at)
            if seen:
                rows = np.concatenate([p["r1"], p["r2"], p["qb"][:, :DIM], np.pad(p["qb"][:, DIM:], ((0, 0), (0, DIM - 1)))]).astype("<f4")
                blob = pa.Array.from_buffers(pa.binary(DIM * 4), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield batch(schema, np.arange(len(rows), dtype=np.int32), np.full(len(rows), float(seen)), blob)

        def total(batches):
            got: dict[int, list] = {}
            for rb in batches:
                for i, w, v in zip(rb.column("row").to_pylist(), rb.column("weight").to_pylist(), rb.column("values").to_pylist(), strict=True):
                    x = got.setdefault(i, [0.0, np.zeros(DIM)])
                    x[0] += w
                    x[1] += w * np.frombuffer(v, "<f4")
            if got:
                yield batch(schema, np.array(list(got), np.int32), np.array([x[0] for x in got.values()]), pa.array([x[1].astype("<f4").tobytes() for x in got.values()], pa.binary()))

        kind = "row int, weight double, values binary"
        out = docs.select("text").mapInArrow(run, kind).repartition(8, "row").mapInArrow(total, kind).collect()  # 4 (n + 1) rows
        if out:
            m = n + 1
            rows = np.zeros((4 * m, DIM), np.float32)
            for r in out:
                rows[r.row] = np.frombuffer(bytes(r["values"]), "<f4") / r.weight
            params = {"r1": rows[:m], "r2": rows[m : 2 * m], "q": rows[2 * m : 3 * m], "b": rows[3 * m :, 0].copy()}
        shared.unpersist()
    return params


def log_probs(sym: np.ndarray, one: np.ndarray, two: np.ndarray, params: dict, step: int = 256) -> np.ndarray:
    """Natural log-probability of each symbol after its two predecessors, normalised over all symbols. `step` contexts at a time
    stay in a core's cache."""
    n = len(params["b"]) - 1
    q = np.column_stack([params["q"][:n], params["b"][:n]]).T.copy()  # the bias is one more dimension
    pair = one.astype(np.int64) * (n + 1) + two
    distinct, inv = np.unique(pair, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    out = np.empty(len(sym), np.float64)
    edge = np.searchsorted(inv[order], np.arange(0, len(distinct) + step, step))
    scores, r = np.empty((step, n), np.float32), np.ones((step, len(q)), np.float32)
    for i, a in enumerate(range(0, len(distinct), step)):
        d = distinct[a : a + step]
        s = scores[: len(d)]
        r[: len(d), :-1] = params["r1"][d // (n + 1)] + params["r2"][d % (n + 1)]
        np.matmul(r[: len(d)], q, out=s)
        own = order[edge[i] : edge[i + 1]]
        row = inv[own] - a
        out[own] = s[row, sym[own]]
        with np.errstate(over="ignore"):
            total = np.exp(s, out=s).sum(axis=1)
        top = 0.0
        if not (total.min() > 1e-25 and total.max() < 1e35):  # out of range: again from the greatest score down
            np.matmul(r[: len(d)], q, out=s)
            top = s.max(axis=1)
            s -= top[:, None]
            total = np.exp(s, out=s).sum(axis=1)
        out[own] -= (np.log(total) + top)[row]
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    docs = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(training_rows())
    vocab = cut(count_tokens(training), "lm-vocab")
    n_all, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    h, c, k = most_frequent(vocab, KNOWN)
    heads = h[:HEAD].copy()
    in_head = c[:HEAD]
    by_class = {r.cls: (r.n, r.s) for r in vocab.groupBy("cls").agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    size, mass = np.zeros(CLASSES), np.zeros(CLASSES)
    for i, (n, s) in by_class.items():
        size[i], mass[i] = n, s
    np.subtract.at(size, k[:HEAD], 1)
    np.subtract.at(mass, k[:HEAD], in_head)
    noise = np.concatenate([in_head, mass]).astype(np.float64) + 0.1
    noise /= noise.sum()
    class_log = np.log10(mass + 0.1 * size + 0.1)  # a class's own normaliser, with one unseen word
    params = train(training, heads, noise)

    shared = spark.sparkContext.broadcast((heads, h, c, params, class_log))
    base_log = float(np.log10(n_all + 0.1 * (v + 1)))
    fields = [("doc_id", pa.int64()), ("th", pa.int64()), ("kind", pa.int8()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64()), ("h", pa.int64()), ("tf", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        heads, h, c, params, class_log = shared.value
        symbols, known = Symbols(heads), HashTable(19)
        known.add(h.view(np.uint64))
        value = np.append(np.log10(c + 0.1), 0.0)
        nh = len(heads)
        for s in slices(batches):
            hs, cs, bound = tokens(Texts(s.column("text"), lower=True))
            sym = symbols.of(hs, cs)
            one, two = contexts(sym, bound, symbols.n)
            lm = log_probs(sym, one, two, params) / _LN10
            at = known.find(hs)
            there = at >= 0
            own = value[at]  # 0 for tokens looked up later
            lm += np.where(sym >= nh, own - class_log[cs], 0.0)
            sums = lambda x, bound=bound: np.add.reduceat(x, bound[:-1])  # noqa: E731  every text has a token
            nd = s.num_rows
            ids, th = s.column("doc_id"), s.column("th")
            zero, none = np.zeros(nd, np.int64), pa.nulls(nd, pa.int64())
            yield batch(schema, ids, th, np.zeros(nd, np.int8), np.diff(bound), sums(there.astype(np.int64)), sums(own), sums(lm), none, zero)
            if not there.all():
                left = np.flatnonzero(~there)
                doc = np.searchsorted(bound, left, side="right") - 1
                key = mix(hs[left]) ^ mix(doc.astype(np.uint64) + U(1))
                _, first, tf = np.unique(key, return_index=True, return_counts=True)
                m = len(first)
                d = pa.array(doc[first])
                z, zf = np.zeros(m, np.int64), np.zeros(m)
                yield batch(schema, ids.take(d), th.take(d), np.ones(m, np.int8), z, z, zf, zf, hs[left][first].view(np.int64), tf)

    kind = "doc_id long, th long, kind byte, n_tokens long, n_known long, base double, lm double, h long, tf long"
    rows = cut(docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, kind), "lm-rows")
    free_shuffles(spark)
    tail = rows.where("kind = 1").select("doc_id", "th", "h", "tf").join(vocab.select("h", "c"), "h", "left")
    got = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("doc_id", "th").agg(F.sum(F.when(got > 0, F.col("tf")).otherwise(0)).alias("tk"), F.sum(F.col("tf") * F.log10(got + 0.1)).alias("tl"))
    # rows that repeat a doc_id and its text each left their rare tokens: m of them
    own = rows.where("kind = 0").groupBy("doc_id", "th").agg(F.count("*").alias("m"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base").alias("base"), F.max("lm").alias("lm"))
    out = own.join(tail.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    tl, tk = F.coalesce(F.col("tl") / F.col("m"), F.lit(0.0)), F.coalesce(F.col("tk") / F.col("m"), F.lit(0)).cast("long")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select("doc_id", (~training_rows()).alias("held_out"), "n_tokens", (F.col("n_known") + tk).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + tl - F.col("n_tokens") * base_log).alias("base_score"), (F.col("lm") + tl).alias("score"))
