"""Byte-level BPE encoding of a corpus with a public vocabulary.

The encoder walks each piece once with the longest tokens an Aho-Corasick automaton
found, backs off to shorter prefix tokens, and accepts a token only if the pair with the
token before it is compatible, i.e. merging the two would never cut differently.  That
gives exactly the merges of BPE in linear time.  Decoding gathers from one byte array
through an offset table.

Defined results: null and empty texts give an empty list; special-token strings in a text
are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import functools
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import batch_of, map_text

#: Public pattern that splits text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file larger than this is refused for the driver-side broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct pieces remembered by a worker (memory only; forgotten pieces are encoded again).
REMEMBERED_PIECES = 200_000
NONE = -1


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the folder is a parameter of the callers."""
    return str(Path("/opt/tokenizers") / name)


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter code of byte-level vocabularies: printable bytes stand
    for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if chr(b) not in out or b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Encoder:
    """One vocabulary: ids, merges, prefix and split tables, automaton and offsets."""

    def __init__(self, raw: bytes) -> None:
        import ahocorasick
        import regex

        model = json.loads(raw)["model"]
        letters = _byte_letters()
        vocab, merges = model["vocab"], model["merges"]
        size = max(vocab.values()) + 1
        token = [b""] * size
        for text, i in vocab.items():
            token[i] = bytes(letters[c] for c in text)
        self.token = token
        ids = {t: i for i, t in enumerate(token) if t}
        self.rank = rank = [0] * size  # order of merging; single bytes come first
        self.pair: dict[int, int] = {}
        self.left = left = list(range(size))
        self.right = right = list(range(size))
        made = set()
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[(x << 32) | y] = z
            rank[z] = r + 1
            if z not in made:
                made.add(z)
                left[z], right[z] = x, y
        self.size = [len(t) for t in token]
        self.shorter = shorter = [NONE] * size
        for i, t in enumerate(token):
            for k in range(len(t) - 1, 0, -1):
                if (j := ids.get(t[:k])) is not None:
                    shorter[i] = j
                    break
        self.ids = ids
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(token):
            if t:
                auto.add_word(t.decode("latin-1"), i)
        auto.make_automaton()
        self.auto = auto
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum(self.size, out=self.offset[1:])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Would BPE keep ``a`` and ``b`` apart when it meets their bytes side by side?"""
        pair, rank, left, right = self.pair, self.rank, self.left, self.right
        limit = 1 << 60
        while True:
            z = pair.get((a << 32) | b)
            if z is not None and rank[z] < limit:
                return False
            # undo the later of the two merges next to the cut
            if rank[a] > rank[b]:
                limit = rank[a]
                a = right[a]
            elif rank[b] > 0:
                limit = rank[b] + 1
                b = left[b]
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        n = len(data)
        if (whole := self.ids.get(data)) is not None and n == 1:
            return [whole]
        longest = [NONE] * n
        size = self.size
        for end, i in self.auto.iter(data.decode("latin-1")):
            longest[end - size[i] + 1] = i
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which no valid end is reached
        pos, cand = 0, longest[0]
        shorter, ok = self.shorter, self.compatible
        while pos < n:
            last = out[-1] if out else NONE
            while cand != NONE:
                end = pos + size[cand]
                if not dead[end] and (last == NONE or ok(last, cand)):
                    break
                cand = shorter[cand]
            if cand != NONE:
                out.append(cand)
                pos += size[cand]
                cand = longest[pos] if pos < n else NONE
            else:
                dead[pos] = 1
                last = out.pop()
                pos -= size[last]
                cand = shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED_PIECES:
                    known.clear()
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of ids by one gather through the offset table."""
        ids = np.asarray(ids, np.int64)
        if len(ids) == 0:
            return b""
        a, n = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.bytes[at].tobytes()


@functools.lru_cache(maxsize=2)
def encoder_of(raw: bytes) -> Encoder:
    return Encoder(raw)


def _shipped(df: DataFrame, path: str | None):
    raw = Path(path or vocabulary_path()).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(raw)} bytes exceeds {MAX_VOCABULARY_BYTES}")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode_corpus(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids list<int>), one row per input row, nothing shuffled."""
    held = _shipped(df, path)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder_of(held.value)
        ids = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
        off = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=off[1:])
        flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(off[-1]))
        return batch_of(id=b.column(0), ids=pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_text(src, "t", fn, "id long, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode_corpus(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) back from the ids; a null list gives the empty text."""
    held = _shipped(df, path)

    def run(batches):
        enc = encoder_of(held.value)
        for b in batches:
            text = [enc.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield batch_of(id=b.column(0), text=pa.array(text, pa.string()))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, "id long, text string").select(F.col("id").alias(id_col), "text")
