"""Byte-level BPE by monoid tree reduction.

Every text is halved down to leaves of a few pretokens, leaves are encoded on their own, and neighbours are joined up the
tree. A join re-encodes a window around the seam and grows it until the tokens outside are proven not to change:

* Between pretokens, a window may end wherever a character that is no white space is followed by white space. No
  alternative of the pretoken pattern goes from the one to the other, so every scan has a boundary there, whatever
  surrounds it, and both sides are encoded independently.
* Inside one long pretoken, a token list is the BPE encoding of its bytes exactly if every two neighbours encode to
  themselves. Both halves fulfil this, so a window is wide enough once the two pairs at its edges do.

Decoding looks up leaves of a few ids and concatenates byte strings up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, map_arrow

#: Characters of a leaf (some ten pretokens), bytes of a leaf inside one pretoken, and ids of a leaf of the decoding tree.
LEAF, PIECE_LEAF, DECODE_LEAF = 64, 16, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def little_endian(ids: array) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes() if ids.itemsize != 4 or sys.byteorder != "little" else ids.tobytes()


class TreeBpe:
    """Encoder and decoder for one vocabulary. ``joins`` counts the joins of neighbours so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, decode_leaf: int = DECODE_LEAF):
        self._core = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        # white space is Unicode's, as in the library
        self.pattern, self.leaf, self.piece_leaf, self.decode_leaf = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")), leaf, piece_leaf, decode_leaf
        self.ranks, self.joins = ranks, 0
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._size_of = [len(x) for x in self.bytes_of]
        self._stable: dict[tuple[int, int], bool] = {}

    # -- encoding ---------------------------------------------------------------------------------------------

    def encode(self, text: str) -> array:
        """The ids of the text."""
        return array("I", self._tree(text, 0, len(text)))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self._core.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        a, b = self._edge_before(text, start, middle), self._edge_after(text, middle, end)
        if a == start and b == end:  # no halves to keep: the tree goes on inside the pretokens
            return self._window(text[start:end])
        return self._join(text, a, middle, b, self._tree(text, start, middle), self._tree(text, middle, end))

    def _join(self, text: str, a: int, middle: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Join two neighbours by re-encoding text[a:b], a window about the seam with provable edges."""
        self.joins += 1
        if a < b:  # else the seam itself is an edge
            del left[len(left) - self._tokens_of(left, len(text[a:middle].encode()), from_end=True) :]
            left += self._window(text[a:b])
            right = right[self._tokens_of(right, len(text[middle:b].encode()), from_end=False) :]
        left += right
        return left

    # A space is looked for, as all but a few edges lie before one; any edge will do, and so will none.

    @staticmethod
    def _edge_before(text: str, start: int, at: int) -> int:
        """The last position in [start, at] before a space that is a boundary of every scan; the start is one in any case."""
        while (at := text.rfind(" ", start + 1, at + 1)) > 0 and text[at - 1].isspace():
            at -= 1
        return at if at > start else start

    @staticmethod
    def _edge_after(text: str, at: int, end: int) -> int:
        """The first position in [at, end] before a space that is a boundary of every scan; the end is one in any case."""
        at = max(at, 1)
        while (at := text.find(" ", at, end)) > 0 and text[at - 1].isspace():
            at += 1
        return at if at > 0 else end

    def _tokens_of(self, ids: list[int], size: int, from_end: bool) -> int:
        """How many tokens at one end make up ``size`` bytes; the position is a token boundary."""
        n, seen, length = 0, 0, self._size_of
        while seen < size:
            seen += length[ids[-1 - n] if from_end else ids[n]]
            n += 1
        if seen != size:
            raise AssertionError("a window edge is no token boundary")
        return n

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._core.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self._piece(m.group().encode())
        return out

    def _piece(self, piece: bytes) -> list[int]:
        """One pretoken: halved, then joined at token level."""
        if len(piece) <= self.piece_leaf:
            return self._core.encode_single_piece(piece)
        middle = len(piece) // 2
        self.joins += 1
        return self._join_tokens(self._piece(piece[:middle]), self._piece(piece[middle:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        n = 1
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            window = self._core.encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            fits_left = i == 0 or self._is_stable(left[i - 1], window[0])
            fits_right = j == len(right) or self._is_stable(window[-1], right[j])
            if fits_left and fits_right:
                return left[:i] + window + right[j:]
            n *= 2

    def _is_stable(self, one: int, two: int) -> bool:
        """Whether two neighbours encode to themselves."""
        found = self._stable.get((one, two))
        if found is None:
            if len(self._stable) > 50_000:
                self._stable.clear()
            found = self._core.encode_single_piece(self.bytes_of[one] + self.bytes_of[two]) == [one, two]
            self._stable[one, two] = found
        return found

    # -- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids: list[int] | array | np.ndarray) -> bytes:
        """The bytes of the ids: leaves of ids are looked up, then neighbours are concatenated up the tree."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        parts = [self._core.decode_bytes(ids[i : i + self.decode_leaf]) for i in range(0, len(ids), self.decode_leaf)]
        while len(parts) > 1:
            parts = list(map(b"".join, zip(parts[::2], parts[1::2], strict=False))) + parts[len(parts) & ~1 :]
        return parts[0] if parts else b""


_ENCODERS: dict[tuple[str, str], TreeBpe] = {}


def encoder(path: str, pattern: str) -> TreeBpe:
    """The encoder of a vocabulary file, built once in each process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the token ids of ``text_col`` as an array of INT; ``path`` is a file on every executor.

    With ``decoded_col``, the ids are decoded again, and the SHA-256 (lowercase hex) of the bytes is added under that name. A
    null or empty text has no ids; rows are independent, so repeated rows get equal ids; an empty table gives an empty
    result. ``keep`` are the columns to carry (all by default), whatever their names; those named like results are replaced.
    """
    added = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in added}]
    slim = docs.select(F.struct(F.lit(0).alias("-"), *[col(docs, c) for c in keep]).alias("row"), col(docs, text_col).alias("body"))
    schema = T.StructType([slim.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 1 + len(added)])

    def run(rows: dict[str, list]) -> dict[str, list]:
        enc = encoder(path, pattern)
        ids = [np.frombuffer(little_endian(enc.encode(t or "")), "<i4") for t in rows["body"]]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        out = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))}
        return out if decoded_col is None else out | {"decoded": [hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]}

    out = map_arrow(slim, run, schema, carry=["row"])
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col(x).alias(name) for x, name in zip(("ids", "decoded"), added, strict=False)])


def decode_ids(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes of an array of ids; a null array stays null, no ids give no bytes, an unknown id is an error.

    A column named like ``bytes_col`` is replaced; an empty table gives an empty result.
    """
    keep = [c for c in df.columns if c.lower() != bytes_col.lower()]
    slim = df.select(F.struct(F.lit(0).alias("-"), *[col(df, c) for c in keep]).alias("row"), col(df, ids_col).alias("tokens"))
    schema = T.StructType([slim.schema["row"], T.StructField("decoded", T.BinaryType())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        enc = encoder(path, pattern)
        return {"decoded": [None if x is None else enc.decode(x) for x in rows["tokens"]]}

    out = map_arrow(slim, run, schema, carry=["row"])
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("decoded").alias(bytes_col))


def token_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", *, text_col: str = "text") -> DataFrame:
    """Per document: key, number of tokens, SHA-256 of the ids and SHA-256 of the bytes that they decode to.

    Encodes and decodes every whole text in one pass over the rows, without a shuffle; a null text is empty; an empty
    table gives an empty result.
    """
    slim = docs.select(col(docs, key).alias("k"), col(docs, text_col).alias("body"))
    schema = T.StructType([slim.schema["k"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        enc, out = encoder(path, pattern), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["body"]:
            ids = enc.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(little_endian(ids)).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return out

    return map_arrow(slim, run, schema, carry=["k"]).withColumnRenamed("k", key)
