"""BPE encoding with reuse of content-defined chunks: shared chunks are encoded once and their joins encoded anew."""
from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import text_of, written

WINDOW, POWER = 16, 0x9E3779B97F4A7C15
INVERSE = pow(POWER, -1, 1 << 64)
#: A place where the pre-tokenizer surely cuts: no blank, then one space, then a letter or digit.
SYNC = re.compile(rb"(?<=[!-~])(?= [A-Za-z0-9])")
#: Characters on which both libraries agree what a letter, digit or blank is; other texts take the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ɏΑ-ΡΣ-ωА-я–—‘-”一-龥]*")


TABLE: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POWER^i and POWER^-i modulo 2^64 for i up to n, kept up to a million."""
    size = max(n, 1 << 14)
    if not TABLE or len(TABLE[0]) < n:
        made = [np.cumprod(np.full(size, p, dtype=np.uint64)) for p in (POWER, INVERSE)]
        if size > 1 << 20:
            return made[0][:n], made[1][:n]
        TABLE[:] = made
    return TABLE[0][:n], TABLE[1][:n]


def boundaries(raw: bytes, bits: int = 10) -> list[int]:
    """Ends of the chunks of a text: where the rolling hash of the last 16 bytes is 0 in its top `bits` bits, and its end.

    The hash at i is a difference of prefix sums of byte * POWER^-i modulo 2^64, times POWER^i. It depends on the window
    only, so equal passages are cut alike wherever they stand.
    """
    n = len(raw)
    if n <= WINDOW:
        return [n] if n else []
    up, down = powers(n)
    sums = np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * down)
    hashed = (sums[WINDOW:] - sums[:-WINDOW]) * up[WINDOW:] * np.uint64(0xD6E8FEB86659FD93)
    cuts = (np.flatnonzero(hashed >> np.uint64(64 - bits) == 0) + WINDOW + 1).tolist()
    return [c for c in cuts if c < n] + [n]


def chunks(raw: bytes, bits: int) -> list[tuple[int, int, bytes]]:
    """(start, end, key) of the core of each chunk: from its first sure cut to its last; chunks without two have no core."""
    out, start = [], 0
    for end in boundaries(raw, bits):
        piece = raw[start:end]
        first = SYNC.search(piece)
        if first:
            last = max((m.start() for m in SYNC.finditer(piece, max(first.start(), len(piece) - 200))), default=first.start())
            if last > first.start():
                core = piece[first.start():last]
                out.append((start + first.start(), start + last, xxhash.xxh3_128_digest(core)))
        start = end
    return out


class Coder:
    """The tokenizers library's ids; plain texts take a faster library with the same vocabulary."""

    def __init__(self, path: str, ranks: str | None, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        self.special = re.compile("|".join(re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()) or "(?!)")
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = self.slow.get_vocab_size()
        self.names = [str(i) for i in range(size)]
        self.packed = "<u2" if size <= 1 << 16 else "<u4"
        self.bytes: list[bytes] | None = None
        if self.fast:
            known = {i: b for b, i in table.items()}
            added = {i: t.content.encode() for i, t in self.slow.get_added_tokens_decoder().items()}
            self.bytes = [added.get(i, known.get(i, b"")) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]) -> bytes:
        """Ids in two bytes each if the vocabulary fits, else four."""
        return np.array(ids, dtype=self.packed).tobytes()

    def unpack(self, raw: bytes) -> list[int]:
        return np.frombuffer(raw, self.packed).tolist()

    def decode(self, ids: list[int]) -> bytes:
        if self.bytes is None:
            return self.slow.decode(ids, skip_special_tokens=False).encode()
        table = self.bytes
        raw = b"".join([table[i] for i in ids])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self.slow.decode(ids, skip_special_tokens=False).encode()

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        names = self.names
        return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


CODERS: dict[tuple, Coder] = {}


def coder(*args) -> Coder:
    if args not in CODERS:
        CODERS[args] = Coder(*args)
    return CODERS[args]


def place(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shared_bits(places: DataFrame, bits: int) -> np.ndarray:
    """A bit table of fixed size that holds the keys seen twice or more; other keys rarely hit it, at no harm."""
    twice = places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    h = F.pmod(F.col("place"), F.lit(bits))
    words = twice.select(F.floor(h / 64).cast("int").alias("w"), (h % 64).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).collect()
    table = np.zeros(bits // 64, dtype=np.int64)
    for row in words:
        table[row["w"]] = row["m"]
    return table


def bpe(docs: DataFrame, path: str, ranks: str | None = None, pattern: str = "", bits: int = 10, table_bits: int = 1 << 22) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs` (doc_id, text), whole texts.

    Texts fall into chunks by a rolling hash. The core of a chunk that occurs more than once in the corpus, between two
    sure cuts of the pre-tokenizer, is encoded once for all; whatever lies between shared cores is encoded in its text, so
    every join is encoded anew from sure cut to sure cut and the ids agree with those of the whole text. Rows of texts
    without shared chunks never shuffle. Null texts are empty and have no ids; repeated rows get equal results.
    """
    args = (path, ranks, pattern)
    text = docs.select("doc_id", text_of("text").alias("text"))

    def keys_of(batches):
        for batch in batches:
            found = [place(k) for raw in batch.column("text").cast(pa.binary()).to_pylist() for _, _, k in chunks(raw, bits)]
            yield pa.RecordBatch.from_pydict({"place": pa.array(found, pa.int64())})

    table = docs.sparkSession.sparkContext.broadcast(shared_bits(text.select("text").mapInArrow(keys_of, "place long"), table_bits))

    def encode(batches):
        own, bitmap = coder(*args), table.value
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                slots = ((c, place(c[2]) % table_bits) for c in chunks(data, bits))
                rows.append(segments_of(own, doc, data, [c for c, p in slots if (int(bitmap[p >> 6]) >> (p & 63)) & 1]))
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    made = written(text.mapInArrow(encode, SQL_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    whole = made.where("ids_sha256 is not null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    parted = made.where("ids_sha256 is null").select("row", "doc_id", "own", F.posexplode("refs").alias("pos", "ref"))
    once = parted.groupBy("ref.key").agg(F.min("ref.core").alias("core"))

    def encode_cores(batches):
        own = coder(*args)
        for batch in batches:
            ids = [own.pack(own.encode(c.decode())) for c in batch.column("core").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "ids": pa.array(ids, pa.binary())})

    coded = written(once.mapInArrow(encode_cores, "key binary, ids binary"))
    used = parted.select("row", "pos", F.col("ref.key").alias("key")).join(coded, "key")
    used = used.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("cores"))
    joined = made.where("ids_sha256 is null").select("row", "doc_id", "own").join(used, "row").select("doc_id", "own", "cores")

    def assemble(batches):
        own = coder(*args)
        for batch in batches:
            rows = []
            for doc, between, cores in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "cores"))):
                ids: list[int] = []
                for k, part in enumerate(between):
                    ids += own.unpack(part)
                    if k < len(cores):
                        ids += own.unpack(cores[k])
                n, a, b = own.digest(ids)
                rows.append({"doc_id": doc, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                                                              ("decoded_sha256", pa.string())]))

    return whole.unionByName(joined.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


SQL_SCHEMA = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, own array<binary>, "
              "refs array<struct<key:binary,core:binary>>")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                    ("own", pa.list_(pa.binary())), ("refs", pa.list_(pa.struct([("key", pa.binary()), ("core", pa.binary())])))])


def segments_of(own: Coder, doc: int | None, data: bytes, shared: list[tuple[int, int, bytes]]) -> dict:
    """A finished row, or the ids between the shared cores of a text and the cores themselves."""
    if not shared:
        n, a, b = own.digest(own.encode(data.decode()))
        return {"doc_id": doc, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b, "own": None, "refs": None}
    between, start = [], 0
    for a, b, _ in shared:
        between.append(data[start:a])
        start = b
    between.append(data[start:])
    return {"doc_id": doc, "n_tokens": None, "ids_sha256": None, "decoded_sha256": None,
            "own": [own.pack(own.encode(p.decode())) for p in between],
            "refs": [{"key": k, "core": data[a:b]} for a, b, k in shared]}
