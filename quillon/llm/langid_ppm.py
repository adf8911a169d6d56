"""Language identification by prediction by partial matching (PPM).

Per language a variable-order byte context tree with escape probabilities (method C: a context that has seen ``d``
distinct bytes in ``n`` events escapes with d / (n + d), to its suffix without the bytes it has seen) is counted on a
bounded sample and then frozen. With frozen statistics the probability of a byte depends only on the longest known
context before it, so the trees of all languages are compiled into one automaton: its states are the contexts that were
seen ``min_count`` times or more in all languages together. A byte that no tree has seen in a state costs what it costs
in the suffix, and the escapes on the way there; so costs are kept for the bytes that were seen, and sums of escapes per
state. A text's score is the exact sum of its bytes' code lengths, in double precision.

The automaton's state depends on the last ``order`` bytes alone. Long inputs are therefore cut into strips that warm up
on the ``order`` bytes before them, and all strips of a batch are advanced together by numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, has_letter, map_arrow

STRIP = 256
#: What is learned from: bytes of text in all, and ranges of hashes of a language, which are taken whole or not at all.
MAX_BYTES, RANGES = 4_000_000, 4096


def folded(text: str) -> bytes:
    """The bytes that the trees see: lower case, so that shouting looks like the language it is in."""
    return text.lower().encode("utf-8", "replace")


@dataclass
class PpmModel:
    """The compiled trees.

    ``step``, ``entry`` and ``level`` are indexed by state * n_classes + class: the next state; whose row of ``bits``
    holds the byte's cost in the longest suffix that a tree has seen it in; and how many escapes away that is. A row of
    ``escapes`` is state * (order + 2) + level. State 0 is the empty context.
    """

    langs: list[str]
    classes: np.ndarray
    step: np.ndarray
    entry: np.ndarray
    level: np.ndarray
    bits: np.ndarray
    escapes: np.ndarray
    n_classes: int
    order: int

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits per text and language, exact sums over all bytes."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not self.langs or not sizes.sum():
            return out
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        first = np.cumsum(sizes) - sizes
        strips = -(-sizes // STRIP)
        owner = np.repeat(np.arange(len(texts)), strips)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
        begin = first[owner] + k * STRIP
        length = np.minimum(STRIP, first[owner] + sizes[owner] - begin)
        longest = np.argsort(-length, kind="stable")  # strips still running are a prefix
        owner, k, begin, length = owner[longest], k[longest], begin[longest], length[longest]
        state = np.zeros(len(owner), np.int64)
        for back in range(self.order, 0, -1):
            warm = k > 0
            state[warm] = self.step[state[warm] * self.n_classes + data[begin[warm] - back]]
        total = np.zeros((len(owner), len(self.langs)), np.float64)
        running = len(owner) - np.searchsorted(length[::-1], np.arange(1, STRIP + 1), side="left")
        for i in range(STRIP):
            n = running[i]
            if not n:
                break
            at = state[:n] * self.n_classes + data[begin[:n] + i]
            total[:n] += self.bits.take(self.entry.take(at), axis=0)
            total[:n] += self.escapes.take(state[:n] * (self.order + 2) + self.level.take(at), axis=0)
            state[:n] = self.step.take(at)
        np.add.at(out, owner, total)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of the shortest code (ties: the first by code point) and its posterior under equal priors."""
        known = [bool(t) and bool(self.langs) and has_letter(t) for t in texts]
        bits = self.code_lengths([folded(t) if k else b"" for t, k in zip(texts, known, strict=True)])
        langs, scores = [], []
        for k, row in zip(known, bits, strict=True):
            if not k:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
        return langs, scores


def fit(sample: dict[str, list[bytes]], *, order: int = 4, min_count: int = 16) -> PpmModel:
    """Count and compile. A context that is kept has all its suffixes kept, as they are seen at least as often."""
    langs = sorted(sample)
    data = {g: b"\n".join(sample[g]) for g in langs}
    seen = np.zeros(256, bool)
    for g in langs:
        seen[np.frombuffer(data[g], np.uint8)] = True
    # bytes that no tree has seen share class 0: every tree gives them the same probability
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, seen.sum() + 1)
    a, unseen = int(seen.sum()) + 1, 256 - int(seen.sum())
    coded = [classes[np.frombuffer(data[g], np.uint8)] for g in langs]

    def grams(x: np.ndarray, n: int) -> np.ndarray:
        code = np.zeros(max(len(x) - n + 1, 0), np.int64)
        for i in range(n):
            code = code * a + x[i : len(x) - n + 1 + i]
        return code

    # sorted codes of the contexts by length, and the number of the first one
    contexts = [np.zeros(1, np.int64)]
    for n in range(1, order + 1):
        code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *[grams(x, n) for x in coded]]), return_counts=True)
        contexts.append(code[count >= min_count])
    first = np.cumsum([0, *map(len, contexts)])
    states = int(first[-1])

    def number(n: int, code: np.ndarray) -> np.ndarray:
        """The states of contexts of a length, -1 if unknown."""
        if not len(contexts[n]):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(contexts[n], code), len(contexts[n]) - 1)
        return np.where(contexts[n][at] == code, first[n] + at, -1)

    step, entry, level = np.zeros((states, a), np.int32), np.zeros((states, a), np.int32), np.zeros((states, a), np.int8)
    escapes, bits = np.zeros((states, order + 2, len(langs))), [np.full((1, len(langs)), 8.0)]  # row 0: order -1, all 256 bytes alike
    weight = np.ones(a)
    weight[0] = unseen
    below = {-1: np.full((1, a, len(langs)), 1 / 256)}
    rows = 1
    for n in range(order + 1):
        m, here = len(contexts[n]), slice(first[n], first[n + 1])
        parent = number(n - 1, contexts[n] % a ** (n - 1)) if n else None
        counts = np.zeros((m, a, len(langs)))
        for i, x in enumerate(coded):
            code, count = np.unique(grams(x, n + 1), return_counts=True)
            at = number(n, code // a) - first[n]
            known = (at >= 0) & (code // a >= 0)
            counts[at[known], (code % a)[known], i] = count[known]
        up = below[n - 1][parent - first[n - 1]] if n else below[-1]
        total, had = counts.sum(axis=1, keepdims=True), counts > 0
        distinct = had.sum(axis=1, keepdims=True)
        rest = (up * weight[None, :, None] * ~had).sum(axis=1, keepdims=True)  # exclusion: what a context has seen can't follow an escape
        some = (total > 0) & (rest > 1e-12)
        # the escape spreads over the rest; a tree without this context goes on in the suffix for nothing
        factor = np.where(some, distinct / np.maximum(total + distinct, 1) / np.maximum(rest, 1e-300), np.where(total > 0, 1e-300, 1.0))
        p = np.where(had, counts / np.maximum(total + np.where(some, distinct, 0), 1), factor * up)
        below[n] = p
        own = had.any(axis=2)
        numbered = np.cumsum(own.ravel()).reshape(own.shape) + rows - 1
        bits.append(-np.log2(np.maximum(p[own], 1e-300)))
        rows += int(own.sum())
        if n:
            entry[here], level[here] = np.where(own, numbered, entry[parent]), np.where(own, 0, level[parent] + 1)
            escapes[here, 1:] = -np.log2(np.maximum(factor, 1e-300)) + escapes[parent, :-1]
        else:
            entry[here], level[here] = np.where(own, numbered, 0), np.where(own, 0, 1)
            escapes[here, 1:] = -np.log2(np.maximum(factor, 1e-300))
        longer = number(n + 1, (contexts[n][:, None] * a + np.arange(a)).ravel()).reshape(m, a) if n < order else np.full((m, a), -1)
        step[here] = np.where(longer >= 0, longer, step[parent] if n else 0)
    # where a context is as long as may be, its last byte's step is its suffix's
    return PpmModel(langs, classes, step.ravel(), entry.ravel(), level.ravel(), np.concatenate(bits), escapes.reshape(states * (order + 2), len(langs)), a, order)


def training_sample(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_bytes: int = MAX_BYTES) -> dict[str, list[bytes]]:
    """Distinct labelled texts by language, ``max_bytes`` of UTF-8 at most, spread evenly over the languages.

    Rows are sampled by a hash of their text: the hashes of a language fall into RANGES, and those ranges are taken, in
    order, that its share still has room for; so the bound holds whatever the rows are, and repeated texts count once. Of
    a text over max_bytes / 256 characters, a slice of that many at a place that its hash gives is learned from, so that
    no language is left out for its texts' length. Null texts and languages and empty texts are no part of it; an empty
    table gives no language.
    """
    most = max(1, max_bytes // 256)
    rows = labelled.select(col(labelled, text_col).alias("t"), col(labelled, lang_col).alias("g")).filter("t is not null and g is not null and t != ''")
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("r", F.shiftrightunsigned("h", 52).cast("int"))
    # a range that holds one text, however often, has that text's size
    size = F.when(F.min("h") == F.max("h"), F.max("n")).otherwise(F.sum("n"))
    ranges = rows.withColumn("n", F.least(F.octet_length("t"), F.lit(4 * most))).groupBy("g", "r").agg(size.cast("long").alias("n")).collect()
    langs = sorted({x["g"] for x in ranges})
    if not langs:
        return {}
    left, picked = dict.fromkeys(langs, max(1, max_bytes // len(langs))), []
    for x in sorted(ranges, key=lambda x: (x["g"], x["r"])):
        if x["n"] <= left[x["g"]]:
            left[x["g"]] -= x["n"]
            picked.append((x["g"], x["r"]))
    if not picked:
        return {}
    chosen = F.broadcast(labelled.sparkSession.createDataFrame(picked, "g string, r int"))  # RANGES rows a language at most
    start = F.pmod("h", F.greatest(F.length("t") - most, F.lit(0)) + 1).cast("int") + 1
    texts = rows.join(chosen, ["g", "r"]).select("g", F.substring("t", start, F.lit(most)).alias("t")).distinct()
    out: dict[str, list[bytes]] = {}
    for x in sorted(map(tuple, texts.collect())):
        out.setdefault(x[0], []).append(folded(x[1]))
    return out


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: PpmModel, *, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0. Only the text counts, and
    all of it; repeated rows get equal results; an empty table gives an empty one. Columns of ``keep`` named like the
    results are replaced.
    """
    keep = [c for c in keep if c.lower() not in PREDICTED.names]
    slim = docs.select(F.struct(F.lit(0).alias("-"), *[col(docs, c) for c in keep]).alias("row"), col(docs, text_col).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        langs, scores = shared.value.predict(rows["body"])
        return {"lang_pred": langs, "score": scores}

    out = map_arrow(slim, run, T.StructType([slim.schema["row"], *PREDICTED.fields]), carry=["row"])
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *PREDICTED.names)
