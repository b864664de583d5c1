"""SentencePiece encoding and decoding: batched Viterbi in numpy over words of equal length."""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import table, tidy
from touchline.llm.registry import query

SPACE, LITERAL = 0x2581, 0x110000  # the mark of a space; the same character in a text, which no piece matches
UNKNOWN = -1000.0
#: Words up to this length are advanced together, longer runs one by one; words of one step; words a worker remembers; words of a run of texts.
TOGETHER, GROUP, CACHE_WORDS, TEXT_RUN = 48, 2048, 400_000, 200_000
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model file: sorted substring hashes with scores and ids.

    A unigram model's scores are log probabilities and used as they are. A BPE model has merge ranks instead of scores; its pieces then count
    one each with the rank as a tie-break, so that the best path has the fewest pieces. Control, unknown and unused pieces never match.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name not in ("identity", "") or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep texts as they are, with a dummy prefix, are supported")
        unigram = model.trainer_spec.model_type == 1
        kinds = type(model.pieces[0])
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int32)
        rows = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
                continue
            usable = p.type in (kinds.NORMAL, kinds.USER_DEFINED)
            self.bytes_of.append(p.piece.replace("▁", " ").encode() if usable else b"")
            if usable:
                rank = -p.score if p.score > -1e8 else len(model.pieces)
                rows.append((p.piece, i, p.score if unigram else -10 - rank / 1e6))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(len(p) for p, _, _ in rows)
        keys = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p, _, _ in rows], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i, _ in rows], np.int32)[order]
        self.scores = np.array([s for _, _, s in rows])[order]
        self.filled = np.zeros(1 << 20, bool)
        self.filled[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = (h * _BASE + codes[:, j] + np.uint64(1)) * _MIX
        return h

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted piece keys; -1 if it is no piece."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = self.filled[(hashes >> np.uint64(44)).astype(np.int64)]
        found = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == found, at, -1)
        return out

    def substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length the pieces that begin at each place of each word (words x places, -1: none)."""
        h, out = np.zeros(codes.shape, np.uint64), []
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            h = (h[:, : codes.shape[1] - n + 1] * _BASE + codes[:, n - 1:] + np.uint64(1)) * _MIX
            out.append(self.probe(h))
        return out

    def best_paths(self, codes: np.ndarray) -> list[bytes]:
        """Ids (little-endian 32-bit) of the best path of each word; all words have the same length and advance together."""
        words, length = codes.shape
        found = self.substrings(codes)
        score = [np.where(f >= 0, self.scores[f], UNKNOWN if n == 0 else -np.inf) for n, f in enumerate(found)]
        best, back = np.full((words, length + 1), -np.inf), np.zeros((words, length + 1), np.int8)
        best[:, 0] = 0
        for end in range(1, length + 1):
            sizes = range(min(end, len(found)), 0, -1)  # of equal paths the longest last piece
            sums = np.stack([best[:, end - n] + score[n - 1][:, end - n] for n in sizes])
            pick = sums.argmax(axis=0)
            best[:, end] = np.take_along_axis(sums, pick[None], 0)[0]
            back[:, end] = sizes[0] - pick
        paths, at, rows = [], np.full(words, length), np.arange(words)
        while (at > 0).any():
            size = np.where(at > 0, back[rows, at], 0)
            begin = at - size
            piece = np.full(words, -2, np.int32)  # -2: the word is over, -1: an unknown character
            for n in range(1, len(found) + 1):
                on = size == n
                piece[on] = found[n - 1][rows[on], begin[on]]
            paths.append((piece, begin))
            at = begin
        return self._collect(codes, paths[::-1])

    def _collect(self, codes: np.ndarray, paths) -> list[bytes]:
        piece, begin = np.stack([p for p, _ in paths], 1), np.stack([b for _, b in paths], 1)
        ids, used = np.where(piece >= 0, self.ids[piece], -1).astype("<i4"), piece != -2
        flat, ends = ids[used].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.flatnonzero((piece == -1).any(axis=1)).tolist():
            on = used[r]
            out[r] = np.concatenate([[i] if i >= 0 else self.spell(int(codes[r, b]))
                                     for i, b in zip(ids[r][on].tolist(), begin[r][on].tolist())]).astype("<i4").tobytes()
        return out

    def spell(self, code: int) -> np.ndarray:
        """Byte pieces of a character that is no piece."""
        return self.byte_ids[list(chr(SPACE if code == LITERAL else code).encode("utf-8", "surrogatepass"))]

    def long_path(self, codes: np.ndarray) -> np.ndarray:
        """The same for one long run: all substrings are probed at once, then one step per character."""
        length, window = len(codes), 1 << 16
        best, back = [0.0], [(0, 0)]
        for base in range(0, length, window):
            part = codes[base: base + window + self.longest]
            found = [f[0] for f in self.substrings(part[None, :])]
            starts: dict[int, list] = {}
            for n, f in enumerate(found):
                for b in np.flatnonzero(f >= 0).tolist():
                    starts.setdefault(b, []).append((n + 1, int(self.ids[f[b]]), float(self.scores[f[b]])))
            for b in range(base, min(length, base + window)):
                for n, i, s in starts.get(b - base, ()) if any(n == 1 for n, _, _ in starts.get(b - base, ())) else [(1, -1, UNKNOWN), *starts.get(b - base, ())]:
                    while len(best) <= b + n:
                        best.append(-np.inf)
                        back.append((0, 0))
                    # ends are reached from earlier starts first, so an equal sum keeps the longest last piece
                    if best[b] + s > best[b + n]:
                        best[b + n], back[b + n] = best[b] + s, (n, i)
        out, at = [], length
        while at > 0:
            n, i = back[at]
            out.append([i] if i >= 0 else self.spell(int(codes[at - 1])))
            at -= n
        return np.concatenate(out[::-1]).astype(np.int32)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points of words of one length, each with the mark of the space before it (words x places)."""
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
        out = np.full((len(words), c.shape[1] + 1), SPACE, np.uint64)
        out[:, 1:] = np.where(c == SPACE, LITERAL, c)
        return out

    def learn(self, words) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if length + 1 > TOGETHER:
                for w in group:
                    self.cache[w] = self.long_path(self.codes([w])[0]).astype("<i4").tobytes()
                continue
            for at in range(0, len(group), GROUP):
                some = group[at: at + GROUP]
                for w, ids in zip(some, self.best_paths(self.codes(some))):
                    self.cache[w] = ids

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Words begin at a space; a text has one space more in front (the dummy prefix), an empty or null text has no ids."""
        out, at = [], 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < TEXT_RUN:  # words of a bounded run of texts are held at once
                some.append(texts[at].split(" ") if texts[at] else [])
                size += len(some[-1])
                at += 1
            new = {w for words in some for w in words}
            new = {w for w in new if w not in self.cache}
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache.clear()
                new = {w for words in some for w in words}
            self.learn(new)
            out += [b"".join(map(self.cache.__getitem__, words)) for words in some]
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, marks turned into spaces, the dummy prefix taken off. What is no valid UTF-8 becomes the replacement character."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One table of pieces per worker and model file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


#: Rows that leave a Python worker together.
OUT_ROWS = 1000


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of the whole text as array<int> in a last column; null and empty texts give an empty array. Other columns stay; nothing is shuffled."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        table = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                ids = table.encode(part.column(part.schema.get_field_index(text)).to_pylist())
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*kept, out])

    return docs.select(*kept).mapInArrow(tidy(run, lambda: pieces(model).cache.clear()), schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of the ids in a last column. A null array gives null."""
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def run(batches):
        table = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                lists = part.column(part.schema.get_field_index(ids))
                ends, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
                # a row's ids become Python numbers only for that row
                texts = [table.decode(values[a:z].tolist()) if held else None for a, z, held in zip(ends, ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, out])

    return rows.select(*kept).mapInArrow(tidy(run), schema)


@query("op2_pieces")
def op2_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(docs, model), model, out="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))
