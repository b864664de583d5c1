"""Token ids in fixed-width bit packing: encode, write blocks in document order, read ranges or documents back."""
from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import ranges, scratch, table, width
from touchline.llm.registry import query

#: A block closes at the end of the first document that brings it to so many ids.
BLOCK_IDS = 1 << 16
#: Words after which a worker's cache takes a turn; it only saves time.
CACHE_WORDS = 400_000
#: Characters of texts that are cut at a time.
RUN_CHARS = 1 << 18
#: Pieces of one call of the library.
CALL_PIECES = 2048
#: Rows that are encoded and leave a Python worker together.
OUT_ROWS = 500
BLOCKS = "bucket int, block long, first long, n_ids long, bits int, payload binary, doc_ids array<bigint>, doc_firsts array<bigint>"


#: Widths whose fields are whole machine integers: the same bytes without shifting.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer file, special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def bits_for(vocabulary: int) -> int:
    """Least number of bits that holds every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of `bits` bits, least significant bit first; eight ids fill exactly `bits` bytes. An id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, np.uint64)
    padded[: len(ids)] = ids
    lanes, out = padded.reshape(groups, 8), np.zeros((groups, bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        field = lanes[:, lane] << np.uint64(shift)
        for t in range((bits + shift + 7) // 8):
            out[:, byte + t] |= ((field >> np.uint64(8 * t)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n - 1 of a payload; only their bytes are touched."""
    if bits in _WHOLE:
        return np.frombuffer(payload, _WHOLE[bits], n, first * bits // 8).astype(np.uint32)
    at = first * bits
    low, high = at // 8, (at + n * bits + 7) // 8
    data = payload[low:high] + bytes(8)
    offsets = np.arange(n, dtype=np.int64) * bits + (at - low * 8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[offsets >> 3]
    return ((words >> (offsets & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


#: Letters before this one have been letters in every version of Unicode that the library may know.
LATIN_END = "ɐ"
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(_HIDDEN)}
_BYTE_SPACE = chr(_BYTE_LETTERS[32])


class _Known(dict):
    """Ids by piece; what is missing is taken from the turn before or made."""

    def __init__(self, make, older):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids with the tokenizers library, piece by piece with a cache.

    The byte-level pattern of the tokenizer always begins a new token at a space that is followed by something else than
    white space, and between a letter and a comma or full stop. So a text is cut there, each different piece is encoded
    once, and the ids are joined; the result is that of encoding the text at once. A piece of Latin letters alone is one word of that pattern, so it
    goes to the library's BPE model without the steps before it; all other pieces go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.marks = {m: self._library([m])[0] for m in ",."}
        self.model = self.tok.model.tokenize if self._plain() else None
        self.spaced = _Known(self._ids, {})  # ids of a piece that follows a space, which is not in the key

    def _plain(self) -> bool:
        """Whether a space and letters are sure to reach the model as one word, in the byte-level alphabet and nothing else."""
        from tokenizers import models, pre_tokenizers

        tok, cut = self.tok, self.tok.pre_tokenizer
        return (isinstance(tok.model, models.BPE) and not tok.model.dropout and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
                and (tok.normalizer, tok.post_processor, tok.truncation, tok.padding) == (None,) * 4
                and not any(t.content.strip().isalpha() for t in tok.get_added_tokens_decoder().values()))

    def _library(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), CALL_PIECES):  # what the library returns is large beside the ids
            out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(pieces[i:i + CALL_PIECES], add_special_tokens=False)]
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces of a text; all but the first follow a space, which they do not hold."""
        parts = text.split(" ")
        if not _LOOSE.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _ids(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ",." and piece[-2].isalpha() and piece[-2] < LATIN_END:
            return self.spaced[piece[:-1]] + self.marks[piece[-1]]
        if self.model is not None and piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            return array("I", [t.id for t in self.model(_BYTE_SPACE + piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
        return self._library([" " + piece])[0]

    def __call__(self, texts) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, run, size = [], [], 0
        for text in texts:
            run.append(text or "")
            size += len(run[-1])
            if size >= RUN_CHARS:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        first = self._library([c[0] for c in cut])
        if len(self.spaced) > CACHE_WORDS:  # what is not asked for in the next turn is forgotten
            self.spaced.older = None
            self.spaced = _Known(self._ids, self.spaced)
        look = self.spaced.__getitem__
        return [f + b"".join(map(look, islice(c, 1, None))) for f, c in zip(first, cut)]


_LOOSE = re.compile(r" (?:\s|$)")
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, bits: int, end: int = 0) -> DataFrame:
    """(doc_id, n_tokens, packed): the packed ids of each text with the end id. A null text is encoded as empty."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                ids = [np.frombuffer(x + tail, "<u4") for x in enc(part.column(1).to_pylist())]
                yield pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "packed": pa.array([pack(x, bits) for x in ids], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, packed binary")


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs (doc_id, text) and write the blocks to path, in ascending doc_id order.

    Documents are dealt to ranges of doc_id; each range is one stream of ids. A row of the format is a block: its range (bucket), number,
    first id within the range, payload, and the documents that begin in it with their first ids. A document lies in one block.
    Null doc_ids come first; rows with equal doc_id are ordered by their ids. An empty table writes no blocks.
    """
    bits = bits_for(vocabulary)
    enc = ranges(encode(docs, tokenizer, bits, end), docs, "doc_id")

    def run(batches):
        state = _Open(bits, block_ids)
        for b in batches:
            for bucket, doc, n, packed in zip(b["bucket"], b["doc_id"], b["n_tokens"], b["packed"]):
                done = state.add(bucket, doc, unpack(packed, bits, 0, n))
                if done is not None:
                    yield done
        done = state.close()
        if done is not None:
            yield done

    enc = enc.repartition(width(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "packed")
    enc.mapInPandas(run, BLOCKS).write.option("compression", "none").parquet(path)


class _Open:
    """The block being filled."""

    def __init__(self, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.bucket = None

    def _fresh(self, block: int, first: int) -> None:
        self.block, self.first, self.n, self.ids, self.docs, self.firsts = block, first, 0, [], [], []

    def add(self, bucket, doc, ids):
        done = None
        if bucket != self.bucket:
            done = self.close()
            self.bucket = bucket
            self._fresh(0, 0)
        elif self.n >= self.block_ids:
            done = self.close()
            self._fresh(self.block + 1, self.first + self.n)
        self.docs.append(None if pd.isna(doc) else int(doc))
        self.firsts.append(self.n)
        self.ids.append(ids)
        self.n += len(ids)
        return done

    def close(self):
        if self.bucket is None or not self.docs:
            return None
        return pd.DataFrame({"bucket": [self.bucket], "block": [self.block], "first": [self.first], "n_ids": [self.n], "bits": [self.bits],
                             "payload": [pack(np.concatenate(self.ids), self.bits)], "doc_ids": [self.docs], "doc_firsts": [self.firsts]})


def open_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the number of ids of all ranges and blocks before; the list of ranges is as long as the shuffle is wide."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("bucket").agg(F.sum("n_ids")).collect())
    before, bases = 0, []
    for bucket, n in totals:
        bases.append((bucket, before))
        before += n
    base = spark.createDataFrame(bases, "bucket int, base long")
    return blocks.join(F.broadcast(base), "bucket").withColumn("start", F.col("base") + F.col("first"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """Random access: (position, id) of ids start .. start + n - 1; other blocks are skipped and only the bytes needed are unpacked."""
    hit = open_blocks(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))

    def run(batches):
        for b in batches:
            for s, m, bits, payload in zip(b["start"], b["n_ids"], b["bits"], b["payload"]):
                low, high = max(0, start - s), min(m, start + n - s)
                yield pd.DataFrame({"position": np.arange(s + low, s + high), "id": unpack(payload, bits, low, high - low).astype(np.int64)})

    return hit.select("start", "n_ids", "bits", "payload").mapInPandas(run, "position long, id long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of all documents; ids are little-endian unsigned 32-bit integers."""
    def run(batches):
        for b in batches:
            for s, m, bits, payload, docs, firsts in zip(b["start"], b["n_ids"], b["bits"], b["payload"], b["doc_ids"], b["doc_firsts"]):
                ids, lows = unpack(payload, bits, 0, m).astype("<u4"), np.asarray(firsts, np.int64)
                highs = np.append(lows[1:], m)
                yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": s + lows, "n_tokens": highs - lows,
                                    "ids": [ids[x:y].tobytes() for x, y in zip(lows, highs)]})

    return (open_blocks(spark, path).select("start", "n_ids", "bits", "payload", "doc_ids", "doc_firsts")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary"))


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    path = scratch(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write(table(spark, sf_dir, "documents"), path, tokenizer, vocabulary_size(tokenizer))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
