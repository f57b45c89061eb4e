"""Token-ID / binary output: raw id shards with a minimal perfect hash index.

Layout of a store (all below one shared folder):

* ``ids/shard-<part>-<attempt>.bin``: the raw token ids of the documents of one
  doc_id range, little-endian, two bytes per id when the vocabulary fits, else
  four; each document ends with the end id;
* ``places``: one row per document with shard file, byte offset and length;
* ``index``: one row per index bucket: a minimal perfect hash over the bucket's
  keys (cascade of bit arrays: a key sits at the first level where no other key
  shares its bit; its slot is the number of set bits before), and per slot a
  32-bit fingerprint, shard, offset and number of ids.

Keyed access hashes the key to its bucket, probes the levels, compares the
stored fingerprint and reads one slice of one shard: constant expected time.

Tasks write shard files under a name of their own attempt; only names that the
committed ``places`` table holds count, so lost and repeated tasks do no harm.
The shared folder must have a scheme that ``pyarrow.fs`` opens (file, hdfs, s3).

Defined results: null text is the empty text (only the end id); null doc_id
sorts first; rows that repeat a doc_id are stored one after another, ordered by
text, under the keys ``(doc_id, 0)``, ``(doc_id, 1)`` ...; other columns are
not read.  An empty table gives an empty store.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stored, table, work_folder

BUCKET_KEYS = 4096
#: words kept per worker; beyond it the cache starts anew
CACHE_WORDS = 2_000_000
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,]?)")
_CODERS: dict = {}


# -- encoding ---------------------------------------------------------------------------------
class WordCoder(dict):
    """White-space separated piece of text -> its ids as raw bytes.

    The tokenizer normalises character by character, drops white space and
    splits at it before merging, so a text's ids are its pieces' ids in order.
    """

    def __init__(self, path: str, wide: bool):
        from tokenizers import Tokenizer
        super().__init__()
        self.full, self.code = Tokenizer.from_file(path), "I" if wide else "H"
        self.model, self.bytes_to_char = self.full.model, {}

    def _chars(self, word: str) -> str:
        if word.isascii():
            return word
        if word not in self.bytes_to_char and len(self.bytes_to_char) > 1000:
            self.bytes_to_char.clear()
        return "".join(self._byte_chars(c) for c in word)

    def _byte_chars(self, c: str) -> str:
        if c not in self.bytes_to_char:
            self.bytes_to_char[c] = "".join(p for p, _ in self.full.pre_tokenizer.pre_tokenize_str(c))
        return self.bytes_to_char[c]

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        s = piece.decode("utf-8", "replace")
        m = _SIMPLE.fullmatch(s)
        if m:
            ids = [t.id for t in self.model.tokenize(self._chars(m[1]))]
            if m[2]:
                ids += [t.id for t in self.model.tokenize(m[2])]
        else:
            ids = self.full.encode(s, add_special_tokens=False).ids
        out = self[piece] = array(self.code, ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        low = raw.lower()  # A-Z only
        # lower case first only where composition cannot change with it, and where
        # nothing can become a special token (these are known in their own case only)
        if low != raw and b"<|" not in raw and (raw.isascii() or (unicodedata.is_normalized("NFC", text)
                                             and unicodedata.is_normalized("NFC", low.decode()))):
            raw = low
        return b"".join(map(self.__getitem__, raw.split()))


def _coder(path: str, wide: bool) -> WordCoder:
    if (path, wide) not in _CODERS:
        _CODERS[path, wide] = WordCoder(path, wide)
    return _CODERS[path, wide]


def vocabulary_width(path: str) -> int:
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _file_system(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


# -- writing ----------------------------------------------------------------------------------
_PLACES = "part int, file string, doc_id long, copy long, at long, n_tokens long"


def _writer(folder: str, path: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        coder, end = _coder(path, width == 4), end_id.to_bytes(width, "little")
        fs, base = _file_system(folder)
        name, out, at, last, copy = f"shard-{part:06d}-{uuid.uuid4().hex}.bin", None, 0, object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(f"{base}/ids", recursive=True)
                out = fs.open_output_stream(f"{base}/ids/{name}", compression=None, buffer_size=1 << 20)
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = coder.encode(text.as_py() or "") + end
                copy = copy + 1 if doc_id == last else 0
                last = doc_id
                out.write(ids)
                rows.append((part, name, doc_id, copy, at, len(ids) // width))
                at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.int64()] * 4))],
                names=["part", "file", "doc_id", "copy", "at", "n_tokens"])
        if out is not None:
            out.close()
    return run


# -- minimal perfect hash ---------------------------------------------------------------------
def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, copy: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    h = _mix(doc_id.astype(np.int64).view(np.uint64), 1)
    return _mix(h ^ _mix(copy.astype(np.uint64) * np.uint64(2) + is_null.astype(np.uint64), 2), 3)


def build_mph(keys: np.ndarray, gamma: float = 1.5) -> tuple[list[int], np.ndarray]:
    """Level sizes and concatenated bits over distinct 64-bit ``keys``."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        size = max(8, int(gamma * len(rest)))
        pos = (_mix(rest, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(pos, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[pos]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def mph_slots(sizes, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        pos = base + (_mix(keys[open_], 100 + level) % np.uint64(size)).astype(np.int64)
        hit = bits[pos]
        out[open_[hit]] = rank[pos[hit]]
        open_, base = open_[~hit], base + size
    return out


_INDEX = ("bucket long, n_keys long, level_sizes array<long>, bits binary, fingerprints binary, "
          "parts binary, ats binary, lengths binary, starts binary, files array<string>")


def _keys_of(t: pa.Table) -> np.ndarray:
    ids = t.column("doc_id").combine_chunks()
    return key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), t.column("copy").to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False))


def _index_bucket(t: pa.Table) -> pa.Table:
    keys = _keys_of(t)
    sizes, bits = build_mph(keys)
    order = np.empty(len(keys), np.int64)
    order[mph_slots(sizes, bits, keys)] = np.arange(len(keys))
    col = lambda n, kind: t.column(n).to_numpy()[order].astype(kind).tobytes()
    row = {"bucket": [t.column("bucket")[0].as_py()], "n_keys": [len(keys)], "level_sizes": [sizes],
           "bits": [np.packbits(bits).tobytes()],
           "fingerprints": [(_mix(keys, 7) >> np.uint64(32)).astype("<u4")[order].tobytes()],
           "parts": [col("part", "<i4")], "ats": [col("at", "<i8")], "lengths": [col("n_tokens", "<i8")],
           "starts": [col("start", "<i8")],
           "files": [t.column("file").take(pa.array(order)).to_pylist()]}
    return pa.table(row, schema=pa.schema([
        ("bucket", pa.int64()), ("n_keys", pa.int64()), ("level_sizes", pa.list_(pa.int64())),
        *[(n, pa.binary()) for n in ("bits", "fingerprints", "parts", "ats", "lengths", "starts")],
        ("files", pa.list_(pa.string()))]))


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n)).alias("bucket")


@dataclass
class TokenStore:
    spark: SparkSession
    folder: str
    width: int
    buckets: int

    def places(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/places")

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.folder}/index")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (doc_id, copy) -> the same with shard, file, at, n_tokens
        and start from the index; unknown keys are left out."""
        asked = keys.select("doc_id", "copy", _bucket(self.buckets))
        return (asked.groupBy("bucket").cogroup(self.index().groupBy("bucket"))
                .applyInArrow(_find, "doc_id long, copy long, shard int, file string, at long, "
                                     "n_tokens long, start long"))

    def read(self, hits: DataFrame) -> DataFrame:
        """Read each hit's slice from its shard file and digest its ids."""
        return (hits.repartition("shard").sortWithinPartitions("shard", "at")
                .mapInArrow(_reader(self.folder, self.width),
                            "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, copy long"))


def _find(asked: pa.Table, index: pa.Table) -> pa.Table:
    names = ["doc_id", "copy", "shard", "file", "at", "n_tokens", "start"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 3]
    schema = pa.schema(list(zip(names, kinds)))
    if not asked.num_rows or not index.num_rows:
        return schema.empty_table()
    row = {c: index.column(c)[0].as_py() for c in index.column_names}
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["level_sizes"])].astype(bool)
    keys = _keys_of(asked)
    slot = mph_slots(row["level_sizes"], bits, keys)
    known = slot >= 0
    prints = np.frombuffer(row["fingerprints"], "<u4")
    known[known] = prints[slot[known]] == (_mix(keys[known], 7) >> np.uint64(32)).astype("<u4")
    slot, asked = slot[known], asked.filter(pa.array(known))
    take = lambda n, kind: pa.array(np.frombuffer(row[n], kind)[slot])
    return pa.Table.from_arrays([asked.column("doc_id").combine_chunks(), asked.column("copy").combine_chunks(),
                                 take("parts", "<i4"), pa.array([row["files"][i] for i in slot], pa.string()),
                                 take("ats", "<i8"), take("lengths", "<i8"), take("starts", "<i8")], schema=schema)


def _reader(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        name, f = None, None
        for b in batches:
            d, crc = b.to_pydict(), []
            for file, at, n in zip(d["file"], d["at"], d["n_tokens"]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/ids/{file}")
                ids = np.frombuffer(f.read_at(n * width, at), f"<u{width}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64()),
                 b.column("shard"), b.column("copy")],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "copy"])
        if f is not None:
            f.close()
    return run


def write_store(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None,
                bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into a store."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = folder or work_folder(spark, "token-store")
    width = vocabulary_width(tokenizer_file)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id")
    places = stored(ranged.sortWithinPartitions("doc_id", "text")
                    .mapInArrow(_writer(folder, tokenizer_file, width, end_id), _PLACES), "places")
    # one row per shard: ids of all shards before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = (places.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
              .select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")))
    (places.join(shards, "part").withColumn("start", F.col("base") + (F.col("at") / width).cast("long"))
     .drop("base").write.parquet(f"{folder}/places"))
    placed = spark.read.parquet(f"{folder}/places")
    store = TokenStore(spark, folder, width, max(1, -(-placed.count() // bucket_keys)))
    (placed.select("*", _bucket(store.buckets)).groupBy("bucket").applyInArrow(_index_bucket, _INDEX)
     .write.parquet(f"{folder}/index"))
    return store


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from the shards by keyed access."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.read(store.lookup(store.places().select("doc_id", "copy"))).drop("copy")
