"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Layout of a shard k in the output folder (little-endian):
    tokens-KKKKK.bin   all ids of its documents, unsigned 16-bit if the vocabulary fits, else unsigned 32-bit
    offsets-KKKKK.bin  n + 1 unsigned 64-bit positions: document i is ids [offsets[i], offsets[i + 1])
    docs-KKKKK.bin     n signed 64-bit document ids (the smallest value stands for null)
Shards hold consecutive ranges of doc_id in ascending order. The global position of a document is its shard's base, a prefix
sum over the shards' totals, plus its offset. Files are written under another name and renamed, so a task that runs twice
leaves the same files. Shards on a file system that Python cannot open are copied through Arrow's file systems.

Edge cases: null or empty text is one end id; null doc_id sorts first; rows that repeat a doc_id each get their own entry, in
the order of their texts' hashes; a text of any length is encoded whole.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.arrowtext import HashTable, Texts, per_text, release
from karst.sources.shared import cut, local_path, new_path, spread, text_hash

END = 0
NULL_ID = -(2**63)
_CACHE: dict = {}
_CACHE_MOST = 500_000  # words kept by a worker, about 40 bytes each
ROWS = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("mark", pa.int64())])


class Encoder:
    """Whole texts to ids by the tokenizers library, with a store of the ids of words seen before.

    In a byte-level vocabulary, a single space before a word starts a new piece and so does a run of line feeds; a text's ids
    are then those of its words, each with the space before it, and of those runs. Distinct ones are known by a 64-bit hash
    and encoded once. Letters alone are one piece and go to the library's merges at once, other words to its full encoder.
    Texts with other white space between words or with an added token's own spelling, and all texts of other kinds of
    vocabularies, go to the library whole.
    When the store is full its newer half goes: frequent words come early.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.vocab = self.tok.get_vocab_size()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        pre = str(self.tok.pre_tokenizer)
        self.byte_level = pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.tok.normalizer is None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte_to_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.table = HashTable(20)
        self.ids = np.zeros(1 << 21, self.kind)
        self.start = np.zeros(1 << 19, np.int64)

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        """Store the ids of new parts under their keys."""
        got: list = [None] * len(parts)
        rest = []
        for i, p in enumerate(parts):
            if len(p) > 1 and not p.strip("\n"):  # line feeds before a word: all but the last are one piece
                got[i] = [k for x in (p[:-1], "\n") for k in self.tok.encode(x, add_special_tokens=False).ids]
                continue
            if p.isalpha() or (p[0] == " " and p[1:].isalpha()):
                if p < "\u0250" and max(p) < "\u0250":
                    got[i] = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.byte_to_char))]
                    continue
            rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            got[i] = e.ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        n = self.table.n
        used = int(self.start[n])
        need = used + int(sizes.sum())
        while need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(parts) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[used:need] = np.fromiter(itertools.chain.from_iterable(got), self.kind, need - used)
        self.start[n + 1 : n + 1 + len(parts)] = used + np.cumsum(sizes)
        self.table.add(keys)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, and n + 1 offsets."""
        if self.table.n > _CACHE_MOST:
            self.table.keep_first(_CACHE_MOST // 2)
        t = Texts(column)
        t.split()
        slow = np.zeros(t.n, bool) if self.byte_level else np.ones(t.n, bool)
        first = np.zeros(len(t.ws), bool)
        first[t.wc[:-1][t.nw > 0]] = True
        gap = np.concatenate([[0], t.we[:-1]]) if len(t.we) else t.ws
        gap = np.where(first, t.off[:-1][t.wd], gap)
        size = t.ws - gap
        lines = np.concatenate([[0], np.cumsum(t.buf == 10)])
        space = (size == 1) & (t.buf[t.ws - 1] == 32)
        fed = (size > 0) & (lines[t.ws] - lines[gap] == size)
        slow[t.wd[~(space | fed | (size == 0))]] = True
        last = np.where(t.nw > 0, t.we[np.maximum(t.wc[1:] - 1, 0)] if len(t.we) else 0, t.off[:-1])
        tail = t.end - last
        tail_fed = (tail == 1) & (t.buf[np.minimum(last, len(t.buf) - 1)] == 10) & (t.nw > 0) if t.n else tail > 0
        slow |= (tail > 0) & ~tail_fed
        slow[self._wide_spaces(t)] = True
        for x in self.added:
            slow |= pc.fill_null(pc.match_substring(column, x), False).to_numpy(zero_copy_only=False)

        where = np.concatenate([t.wc[1:][tail_fed], np.flatnonzero(fed)])
        lo = np.insert(t.ws - space, where, np.concatenate([last[tail_fed], gap[fed]]))
        hi = np.insert(t.we, where, np.concatenate([t.end[tail_fed], t.ws[fed]]))
        units = t.nw + tail_fed + per_text(fed.astype(np.int64), t.wc)
        part_to = np.concatenate([[0], np.cumsum(units)])
        keys = t.hashes(lo, hi)
        at = self.table.find(keys)
        if len(new := np.flatnonzero((at < 0) & ~np.repeat(slow, units))):
            some, i = np.unique(keys[new], return_index=True)
            i = np.sort(new[i])
            data = t.buf.tobytes()
            self._learn(keys[i], [data[a:z].decode() for a, z in zip(lo[i].tolist(), hi[i].tolist(), strict=True)])
            at = self.table.find(keys)
        at = np.maximum(at, 0)
        start, count = self.start[at], self.start[at + 1] - self.start[at]
        if slow.any():
            count[np.repeat(slow, units)] = 0
        bound = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(bound[-1]) + np.repeat(start - bound[:-1], count)]
        n_ids = bound[part_to[1:]] - bound[part_to[:-1]]
        whole = np.flatnonzero(slow & (t.end > t.off[:-1]))
        texts = {i: np.array(self.tok.encode(column[i].as_py(), add_special_tokens=False).ids, self.kind) for i in whole.tolist()}
        for i, x in texts.items():
            n_ids[i] = len(x)
        off = np.concatenate([[0], np.cumsum(n_ids + 1)])
        out = np.full(off[-1], END, self.kind)
        keep = np.ones(len(out), bool)
        keep[off[1:] - 1] = False
        for i, x in texts.items():
            keep[off[i] : off[i + 1]] = False
            out[off[i] : off[i + 1] - 1] = x
        out[keep] = ids
        return out, off

    @staticmethod
    def _wide_spaces(t: Texts) -> np.ndarray:
        """Texts with white space beyond ASCII, or with the control characters that libraries judge differently."""
        b = t.buf
        i = np.flatnonzero(((b >= 0xE1) & (b <= 0xE3)) | (b == 0xC2) | ((b >= 0x1C) & (b <= 0x1F)))
        if not len(i):
            return i
        x, y, z = b[i], b[np.minimum(i + 1, len(b) - 1)], b[np.minimum(i + 2, len(b) - 1)]
        bad = (x < 0x20) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((x == 0xE3) & (y == 0x80))
        return np.unique(np.searchsorted(t.off, i[bad], side="right") - 1)


def encoder(path: str) -> Encoder:
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


@contextlib.contextmanager
def _publish(folder: str, name: str):
    """A local file to write that appears in the folder under its name at the end."""
    if local := local_path(folder):
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            yield f
        os.replace(part, f"{local}/{name}")
    else:
        from pyarrow import fs

        with tempfile.NamedTemporaryFile(delete=True) as f:
            yield f
            f.flush()
            store, at = fs.FileSystem.from_uri(folder)
            store.create_dir(at, recursive=True)
            with open(f.name, "rb") as src, store.open_output_stream(f"{at}/.{name}.{os.getpid()}") as dst:
                shutil.copyfileobj(src, dst, 1 << 22)
            store.move(f"{at}/.{name}.{os.getpid()}", f"{at}/{name}")


@contextlib.contextmanager
def mapped(folder: str, name: str, kind):
    """A read-only memory map of a file of the folder."""
    local, temp = local_path(folder), None
    if not local:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        temp = tempfile.mkdtemp()
        local = temp
        with store.open_input_stream(f"{at}/{name}") as src, open(f"{temp}/{name}", "wb") as dst:
            shutil.copyfileobj(src, dst, 1 << 22)
    path = f"{local}/{name}"
    yield np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    if temp:
        shutil.rmtree(temp, ignore_errors=True)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, mark: str | None = None, step: int = 1 << 20) -> DataFrame:
    """Write the files in ascending order of doc_id; returns one row per document: shard, row, doc_id, local, n_tokens, mark.

    mark: a long column to carry along, such as a place in another order. Runs now, once."""
    from pyspark import TaskContext

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(mark) if mark else F.lit(None)).cast("long").alias("mark"))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    order = F.col("doc_id").asc_nulls_first()
    rows = rows.repartitionByRange(n, order).sortWithinPartitions(order, text_hash(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        at = row = 0
        with _publish(folder, f"tokens-{shard:05d}.bin") as tokens, _publish(folder, f"offsets-{shard:05d}.bin") as offsets, _publish(folder, f"docs-{shard:05d}.bin") as ids:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                lo = 0
                while lo < b.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + step, side="right")))
                    part = b.slice(lo, hi - lo)
                    lo = hi
                    out, off = enc.encode(part.column("text"))
                    tokens.write(out.astype(out.dtype.newbyteorder("<"), copy=False).tobytes())
                    offsets.write((off[1:] + at).astype("<u8").tobytes())
                    doc = part.column("doc_id")
                    ids.write(pc.fill_null(doc, NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    k = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard, np.int32)), pa.array(np.arange(row, row + k)), doc.cast(pa.int64()), pa.array(off[:-1] + at), pa.array(np.diff(off)), part.column("mark")], schema=ROWS)
                    at, row = at + int(off[-1]), row + k
        release()

    return cut(rows.mapInArrow(write, "shard int, row long, doc_id long, local long, n_tokens long, mark long"), "token-rows")


def shard_bases(rows: DataFrame) -> DataFrame:
    """shard, base: ids of all documents in earlier shards. One row a shard, so the one-task prefix sum is over few rows."""
    from pyspark.sql import Window

    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("base"))


def read_tokens(bases: DataFrame, folder: str, vocab: int) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. Shards are mapped, never loaded whole."""
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("row", pa.int64())])

    def read(batches):
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
                with mapped(folder, f"tokens-{shard:05d}.bin", kind) as ids, mapped(folder, f"offsets-{shard:05d}.bin", "<u8") as off, mapped(folder, f"docs-{shard:05d}.bin", "<i8") as docs:
                    for a in range(0, len(docs), 4096):
                        o = np.asarray(off[a : a + 4097]).astype(np.int64)
                        some = np.asarray(ids[o[0] : o[-1]]).astype("<u4")
                        crc = [zlib.crc32(some[i:j]) for i, j in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist(), strict=True)]
                        d = np.asarray(docs[a : a + 4096])
                        k = len(d)
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64(), mask=d == NULL_ID), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64()), pa.array(np.full(k, shard, np.int32)), pa.array(np.arange(a, a + k))], schema=schema)

    n = bases.sparkSession.sparkContext.defaultParallelism
    return bases.repartition(max(n, bases.sparkSession.sparkContext.defaultParallelism * 4), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, row long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, mark: str | None = None) -> DataFrame:
    """Encode, write, read back. One row per document; shard and row say where its ids lie, mark is carried along."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    vocab = encoder(tokenizer).vocab
    rows = write_tokens(spread(docs), tokenizer, folder, mark)
    out = read_tokens(cut(shard_bases(rows), "token-bases"), folder, vocab)
    return out.join(rows.select("shard", "row", "mark"), ["shard", "row"], "left") if mark else out
