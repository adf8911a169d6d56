"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments. The Manhattan distance of two such vectors
is a lower bound of the Hamming distance, and the vector packs into one BIGINT (a nibble per count), computed by shifts
and masks in the JVM. Fingerprints within two bits have vectors within Manhattan distance two, so both reach a common
grid cell by at most one step of one: each fingerprint is registered in its own cell and those one step away, and cells
that several reach hold the candidates.

Inside such a cell they are verified exactly, without pairing the cell with itself: two fingerprints within two bits have
a common one within one bit of both, their centre, whose vector is a cell that both reach. So each is registered with its
centres in the cell (itself, or those that a flipped bit of the stepped segment gives), 65 fingerprints at most share a
centre, all of them within two bits of each other, and one link to the smallest of them is enough.

Links join distinct fingerprints (copies are one fingerprint); components come from minimum labels with pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import col, forget, give_back, map_arrow, marked, nested, row_hash, sized, small_side, stored, unnested

#: Shingles that are hashed at once.
BLOCK = 1 << 15


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included, over XXH64 with seed 42; as a signed 64-bit integer."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])
    first, last = begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(slim: DataFrame, *, shingle: int = 3) -> DataFrame:
    """All columns of ``slim`` but ``body`` (a text in UTF-8), and fp, the fingerprint of that; no words, or null, gives zero."""
    keep = [c for c in slim.columns if c != "body"]
    schema = T.StructType([slim.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return map_arrow(slim, lambda rows: {"fp": [fingerprint(x, shingle) for x in rows["body"]]}, schema, carry=keep)


def _nibbles(x: str) -> str:
    """SQL: the bit counts of the 16 four-bit segments, one in each nibble."""
    ones = 1229782938247303441  # the lowest bit of every nibble; four such terms can't overflow
    return "(" + " + ".join(f"(shiftrightunsigned({x}, {i}) & {ones}L)" for i in range(4)) + ")"


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints (column ``fp``) that connect all within two differing bits; stored.

    Each link is within two bits, and any two fingerprints within two bits are connected by links.
    """
    # the cells that are reached: the vector's own, and one step up or down in each segment, where there is one
    ways = prints.select("fp", F.expr(_nibbles("fp")).alias("own"), F.explode(F.expr("sequence(0, 32)")).alias("way"))
    ways = ways.selectExpr("fp", "own", "cast((way + 1) div 2 as int) - 1 as segment", "if(way = 0, 0, if(way % 2 = 1, 1, -1)) as step")
    count = "(shiftrightunsigned(own, 4 * segment) & 15L)"
    cells = ways.filter(f"step = 0 or step = 1 and {count} < 4 or step = -1 and {count} > 0").selectExpr("fp", "segment", "step", "if(step = 0, own, own + shiftleft(cast(step as bigint), 4 * segment)) as cell")
    # many more than there are fingerprints, which the planner can't see: so they are counted before they are joined
    full = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("cell").alias("full")))
    shared = cells.join(small_side(full), F.col("cell") == F.col("full"))
    bit = "shiftleft(1L, 4 * segment + b)"
    flipped = f"transform(filter(sequence(0, 3), b -> (fp & {bit} = 0) = (step = 1)), b -> fp ^ {bit})"
    centres = shared.select("fp", F.explode(F.expr(f"if(step = 0, array(fp), {flipped})")).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_list("fp").alias("m")).filter("size(m) > 1")  # 65 at most
    out = stored(met.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a < b and bit_count(a ^ b) <= 2").distinct())
    forget(full)
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The smallest label reachable from each node: ``edges`` (a, b), ``nodes`` (node, label) of the nodes with an edge; null labels come last.

    Rounds of taking the smallest label next door and then following it one jump, until none changes; each round's
    labels are stored in the shared folder. Returns (node, component).
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # the smallest label's node stands for it, so that jumps can follow it
    state = stored(nodes.select("node", F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("l"), F.col("node").alias("of")).alias("root")))
    rows = state.count()
    while True:
        near = both.join(sized(state.select(F.col("node").alias("b"), "root"), rows), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = stored(state.join(sized(near, rows), F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        ahead = step.select(F.col("node").alias("at"), F.col("root").alias("ahead"))
        after = stored(step.join(sized(ahead, rows), F.col("root.of") == F.col("at"), "left").select("node", "was", F.least("root", "ahead").alias("root")))
        forget(state, step)
        if after.filter("was != root").limit(1).count() == 0:
            forget(both)
            return after.select("node", F.col("root.l").alias("component"))
        state = after.select("node", "root")


def cluster(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: ``key``, fp (fingerprint) and component (the smallest key reachable over links, itself included).

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Repeated rows share a
    component; a null key never stands for a component unless all keys in it are null; an empty table gives an empty
    result. Other columns of ``docs`` may have any name.
    """
    rows = stored(fingerprints(docs.select(col(docs, key).alias("k"), col(docs, text_col).cast("binary").alias("body")), shingle=shingle))
    prints = stored(rows.groupBy("fp").agg(F.min("k").alias("label"), F.count(F.lit(1)).alias("n")))
    edges = links(prints.select("fp"))
    ends = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).distinct()
    linked = components(edges, prints.join(sized(ends, 2 * edges.count()), "fp", "left_semi").select(F.col("fp").alias("node"), "label"))
    # a fingerprint of its own, with one row, needs no lookup
    known = stored(prints.join(small_side(linked), F.col("fp") == F.col("node"), "left").filter("n > 1 or node is not null").select(F.col("fp").alias("f"), F.when(F.col("node").isNull(), F.col("label")).otherwise(F.col("component")).alias("component")))
    forget(prints, edges, linked)
    found = rows.join(small_side(known), F.col("fp") == F.col("f"), "left")
    return found.select(F.col("k").alias(key), "fp", F.when(F.col("f").isNull(), F.col("k")).otherwise(F.col("component")).alias("component"))


# -- near-duplicates at a given similarity of shingle sets -------------------------------------------------------
#
# One fingerprint within two bits only finds texts that are nearly equal: at a Jaccard similarity of 0.8 of the shingle
# sets, fingerprints of whole texts differ in some ten bits, where a grid of bit counts rules hardly anything out. For
# such a threshold, fingerprints of small samples join the one of the whole text: in each of several views, the SimHash
# of the few shingles that come first in the view's order. Samples of texts with similarity s agree with probability
# s ** SAMPLE in each view. What meets is verified by the exact Jaccard similarity of all shingles.
#
# Texts that share a sample's fingerprint form a group, which may be large. First each is compared with the group's leader
# (the text that meets most others in all its groups, so one near the origin of edited copies, and often the same one in
# many groups); links found connect most of a group. Then only those stay open that aren't connected with their leader; they are compared with all of
# the group, in blocks of bounded size whose comparisons stay in their task and yield links of a spanning forest alone.
# Groups of all sizes go the same way, and nothing that shares a fingerprint is left uncompared or unconnected.

VIEWS, SAMPLE = 24, 3
#: Open members, and members that they are compared with, in a block (about so many, dealt by a hash).
OPEN_ROWS, BLOCK_ROWS = 256, 256
#: Shingles that are multiplied at once.
COLUMNS = 4096
#: Keys of orders that are computed at once.
ORDERED = 1 << 19
_SEEDS = np.array([int.from_bytes(hashlib.sha256(b"view %d" % i).digest()[:8], "little") for i in range(64)], np.uint64)


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, sorted; a text with fewer words is one shingle."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    size, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


def view_orders(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A row per seed: the hashes' keys in that view's order, by the finaliser of SplitMix64, so that views are independent."""
    with np.errstate(over="ignore"):
        x = hashes[None, :] ^ seeds[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def view_prints(hashes: np.ndarray, views: int = VIEWS, sample: int = SAMPLE) -> list[int]:
    """Per view the SimHash (bitwise majority) of the shingles that come first in its order."""
    out: list[int] = []
    if not len(hashes):
        return out
    at_once = max(1, ORDERED // len(hashes))
    for low in range(0, views, at_once):
        order = view_orders(hashes, _SEEDS[low : min(views, low + at_once)])
        first = np.argpartition(order, sample, axis=1)[:, :sample] if len(hashes) > sample else np.broadcast_to(np.arange(len(hashes)), order.shape)
        bits = np.unpackbits(hashes[first].view(np.uint8).reshape(*first.shape, 8), axis=2, bitorder="little").sum(axis=1)
        out += np.packbits((2 * bits > first.shape[1]).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel().tolist()
    return out


def _text_id(text: Column) -> Column:
    """Two hashes that stand for a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _described(docs: DataFrame, text_col: str, shingle: int, key: str) -> DataFrame:
    """Rows (k, id, n, fp, views): key, text, number of shingles, fingerprints of the text and of its samples."""
    text = col(docs, text_col)
    slim = docs.select(col(docs, key).alias("k"), _text_id(text).alias("id"), text.cast("binary").alias("body"))
    schema = T.StructType([slim.schema["k"], slim.schema["id"], T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("views", T.ArrayType(T.LongType()))])

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"n": [], "fp": [], "views": []}
        for raw in rows["body"]:
            hashes = shingle_hashes(raw, shingle)
            out["n"].append(len(hashes))
            out["fp"].append(fingerprint(raw, shingle))
            out["views"].append(view_prints(hashes))
        return out

    return map_arrow(slim, run, schema, carry=["k", "id"])


def _sets(docs: DataFrame, text_col: str, shingle: int, ends: DataFrame) -> DataFrame:
    """Rows (e, s): the texts ``ends`` (column e) and their distinct shingles."""
    schema = T.StructType([ends.schema["e"], T.StructField("s", T.ArrayType(T.LongType()))])
    text = col(docs, text_col)
    slim = docs.select(_text_id(text).alias("id"), text.cast("binary").alias("body"))
    met = slim.join(small_side(ends), F.col("id") == F.col("e"), "left_semi").select(F.col("id").alias("e"), "body")
    return map_arrow(met, lambda rows: {"s": [shingle_hashes(t, shingle).view(np.int64) for t in rows["body"]]}, schema, carry=["e"]).dropDuplicates(["e"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of ``least`` or more."""
    one, two = sets.select(F.col("e").alias("a"), F.col("s").alias("sa")), sets.select(F.col("e").alias("b"), F.col("s").alias("sb"))
    # sets are wide, so however few they are, they are never broadcast
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("common") >= least * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-6).select("a", "b")


def forest(rows: np.ndarray, values: np.ndarray, first: np.ndarray, second: np.ndarray, n: int, least: float) -> list[tuple[int, int]]:
    """Links that connect, of members 0 to n - 1, all of ``first`` with all of ``second`` within Jaccard ``least``.

    ``rows`` and ``values`` are the members' shingles, each distinct in its member.
    """
    sizes = np.bincount(rows, minlength=n)
    _, column = np.unique(values, return_inverse=True)
    places = [np.full(n, -1), np.full(n, -1)]
    for place, side in zip(places, (first, second), strict=True):
        place[side] = np.arange(len(side))
    shared = np.ones(column.max(initial=-1) + 1, bool)
    for place in places:  # a shingle counts if both sides have it
        shared &= np.bincount(column[place[rows] >= 0], minlength=len(shared)) > 0
    numbered = np.cumsum(shared) - 1
    use = shared[column]
    order = np.argsort(numbered[column[use]], kind="stable")
    row, col = rows[use][order], numbered[column[use]][order]
    common = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(col, [low, low + COLUMNS])
        sides = []
        for place, side in zip(places, (first, second), strict=True):
            at, inside = place[row[i:j]], np.zeros((len(side), COLUMNS), np.float32)
            inside[at[at >= 0], col[i:j][at >= 0] - low] = 1
            sides.append(inside)
        common += sides[0] @ sides[1].T
    both = sizes[first][:, None] + sizes[second][None, :] - common
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(common >= least * both - 1e-6)), strict=True):
        a, b = find(int(first[i])), find(int(second[j]))
        if a != b:
            root[b] = a
            out.append((int(first[i]), int(second[j])))
    return out


def _compared_in_blocks(open_rows: DataFrame, members: DataFrame, sets: DataFrame, least: float, groups: int) -> DataFrame:
    """Links (a, b) that connect the open members (g, id) with those of ``members`` (g, id, size, open) in their group; ``groups`` at most."""
    counts = open_rows.groupBy("g").agg(F.count(F.lit(1)).alias("several")).select(F.col("g").alias("gg"), "several")
    at = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n)).cast("int")
    held = members.join(sized(counts, groups), F.col("g") == F.col("gg")).withColumns({"rows": at("several", OPEN_ROWS), "columns": at("size", BLOCK_ROWS)})
    # an open member comes once per block of the others, another one once per block of the open ones
    first = held.filter("open").select("g", own("rows").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("open"), "id")
    second = held.select("g", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), own("columns").alias("j"), F.lit(False).alias("open"), "id")
    dealt = first.unionByName(second).join(sets.hint("merge"), F.col("id") == F.col("e")).select("g", "i", "j", "open", "id", "s")
    link = T.StructType([T.StructField(c, members.schema["id"].dataType) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ("g", "i", "j")):
            ids, listed, mark = block.column("id").combine_chunks(), block.column("s").combine_chunks(), block.column("open").to_numpy()
            rows = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy()))
            found = forest(rows, listed.flatten().to_numpy(), np.flatnonzero(mark), np.flatnonzero(~mark), len(ids), least)
            pairs = [ids.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])
        give_back()

    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, link).filter("a != b")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that follow each other and agree in ``keys``, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(low, high - low)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _labels(edges: DataFrame) -> DataFrame:
    """(node, component) of the texts with an edge: the smallest text of each component."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return components(edges, nodes.select("node", F.col("node").alias("label")))


def _edges(docs: DataFrame, texts: DataFrame, text_col: str, shingle: int, least: float) -> DataFrame:
    """Verified links (a, b) that connect all candidates with a similarity of ``least`` or more; ``texts``: (id, n, fp, views), distinct."""
    by_view = texts.select("id", "n", F.posexplode("views").alias("view", "print")).unionByName(texts.select("id", "n", F.lit(-1).alias("view"), F.col("fp").alias("print")))
    by_view = by_view.select(F.xxhash64("view", "print").alias("g"), "id", "n")
    sizes = stored(by_view.groupBy("g").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("g").alias("gg"), "size"))
    groups = sizes.count()
    shared = stored(by_view.join(sized(sizes, groups), F.col("g") == F.col("gg")).drop("gg"))
    # a group's leader is the text that meets most others in all its groups: of edited copies, one near their origin
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight")).select(F.col("id").alias("w"), "weight")
    weighed = shared.join(sized(weights, shared.count()), F.col("id") == F.col("w")).select("g", "id", "n", "size", F.struct("weight", F.xxhash64("id").alias("turn"), "id", "n").alias("rank"))
    lead = weighed.groupBy("g").agg(F.max("rank").alias("lead")).select(F.col("g").alias("gg"), F.col("lead.id").alias("leader"), F.col("lead.n").alias("m"))
    members = stored(shared.join(sized(lead, groups), F.col("g") == F.col("gg")).drop("gg"))
    # whole fingerprints that differ in one or two bits: the smallest texts stand for them
    prints = stored(texts.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("first")))
    one, two = prints.select(F.col("fp").alias("a"), F.col("first.id").alias("x"), F.col("first.n").alias("nx")), prints.select(F.col("fp").alias("b"), F.col("first.id").alias("y"), F.col("first.n").alias("ny"))
    alike = links(prints.select("fp"))
    close = alike.join(small_side(one), "a").join(small_side(two), "b").select("x", "nx", "y", "ny")
    led = members.filter("id != leader").select(F.col("leader").alias("x"), F.col("m").alias("nx"), F.col("id").alias("y"), F.col("n").alias("ny"))
    fit = led.unionByName(close).filter(F.least("nx", "ny") >= F.greatest("nx", "ny") * least)
    pairs = stored(fit.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    ends = stored(members.select(F.col("id").alias("e")).unionByName(pairs.select(F.col("a").alias("e"))).unionByName(pairs.select(F.col("b").alias("e"))).distinct())
    sets = stored(_sets(docs, text_col, shingle, ends))
    found = stored(_verified(pairs, sets, least))
    # what isn't connected with its leader by now stays open; the leader itself has met all
    known = _labels(found)
    labelled = known.count()
    of = lambda name, c: sized(known.select(F.col("node").alias(name), F.col("component").alias(c)), labelled)
    held = members.join(of("p", "own"), F.col("id") == F.col("p"), "left").join(of("q", "of_leader"), F.col("leader") == F.col("q"), "left")
    apart = ~F.coalesce(F.col("own") == F.col("of_leader"), F.lit(False)) & (F.col("id") != F.col("leader"))
    rest = stored(held.filter("size > 2 and id != leader").select("g", "id", "size", apart.alias("open")))
    more = _compared_in_blocks(rest.filter("open"), rest, sets, least, groups)
    out = stored(found.unionByName(more).distinct())
    forget(sizes, shared, members, prints, alike, pairs, ends, sets, found, known, rest)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (k, id, copies, keep): each key and text (two hashes) with words, how often it comes, and its group's keeper (k, id).

    Links are pairs of texts with a Jaccard similarity of ``least`` or more of their shingle sets (a text of fewer words
    is one shingle); equal texts are linked. The keeper is the smallest key, a null key last, then the smallest text.
    Null and empty texts, and those without words, are no part of it; an empty table gives an empty result.
    """
    rows = stored(_described(docs, text_col, shingle, key).filter("n > 0"))
    texts = stored(rows.select("id", "n", "fp", "views").dropDuplicates(["id"]))
    edges = _edges(docs, texts, text_col, shingle, least)
    known = _labels(edges)
    each = rows.groupBy("k", "id").agg(F.count(F.lit(1)).alias("copies"))
    each = stored(each.join(small_side(known), F.col("id") == F.col("node"), "left").select("k", "id", "copies", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("of")))
    keeper = each.groupBy("of").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "id")).alias("keep"), F.count(F.lit(1)).alias("rows"), F.max("copies").alias("most"))
    keeper = stored(keeper.filter("rows > 1 or most > 1").select(F.col("of").alias("f"), F.struct("keep.k", "keep.id").alias("keep")))
    out = stored(each.join(small_side(keeper), F.col("of") == F.col("f"), "left").select("k", "id", "copies", F.coalesce("keep", F.struct("k", "id")).alias("keep")))
    forget(rows, texts, edges, known, each, keeper)
    return out


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less those whose group of near-duplicates has another keeper.

    The keeper is the row with the smallest key (a null key last); of rows that agree in key and text, the one with the
    smallest hash of all columns stays. Null and empty texts, and those without words, are no near-duplicates of anything
    and all stay. Rows that a bitmap of what is to be dropped doesn't mark are passed on where they are.
    """
    found = near_duplicates(docs, key, text_col=text_col, shingle=shingle, least=least)
    hashed = F.xxhash64("k", "id")
    gone = found.filter(~F.struct("k", "id").eqNullSafe(F.col("keep")))
    looked_up = stored(found.filter(~F.struct("k", "id").eqNullSafe(F.col("keep")) | (F.col("copies") > 1)).select(hashed.alias("h")))
    words = F.coalesce(col(docs, text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = marked(nested(docs, k=col(docs, key), id=_text_id(col(docs, text_col)), words=words, order=row_hash(docs)).withColumn("h", hashed), looked_up)
    rows = rows.withColumn("maybe", F.col("maybe") & F.col("words"))
    gone = gone.select(hashed.alias("g"), F.col("k").alias("l"), F.col("id").alias("t"))
    doubtful = rows.filter("maybe").join(small_side(gone), (F.col("h") == F.col("g")) & F.col("k").eqNullSafe(F.col("l")) & (F.col("id") == F.col("t")), "left_anti")
    stay = doubtful.groupBy("k", "id").agg(F.min_by("row", "order").alias("row"))
    return unnested(rows.filter("not maybe").select("row").unionByName(stay.select("row")), docs.columns)
