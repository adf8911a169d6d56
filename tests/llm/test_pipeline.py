"""The pipeline, every stage recomputed by brute force from what the stage before it kept."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

sys.path.insert(0, str(Path(__file__).parent))
from cases import CLASHING, assert_rows_of, documents  # noqa: E402
from test_operators import SF, WORD, base_of, near_groups, shares  # noqa: E402

from quillon.llm import mixing, quality  # noqa: E402
from quillon.llm.common import stored  # noqa: E402

TEXTS = 3 * ["a copy of a text that comes three times, which exact dedup has to find among twenty words or more of prose like this one here"]


def tables(spark):
    """Whole small documents; awkward rows; exact and near copies whose keys tell which of them stays."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], f"edit{i}", *words[i + 1 :]]) for i in (0, 1, 30, 59)] + [" ".join(words)]
    return {"documents": spark.read.parquet(f"{SF}/documents.parquet"), "awkward": documents(spark), "copies": documents(spark, [*TEXTS, *near, *near[:2]]), "empty": documents(spark, [])}


def rejected(rows, kept):
    """Rows of documents that fail the base rule are out; the others' verdicts are compared with SQL and exact quantiles in test_operators."""
    return [r for r in rows if base_of(r["text"])[-1]], [r for r in kept if base_of(r["text"])[-1]]


def check_quality(spark, docs, out):
    assert_rows_of(out, docs)
    failed, still = rejected(docs.collect(), out.collect())
    assert not still and len(failed) + out.count() <= docs.count()
    judged = quality.judged(docs).collect()
    assert Counter(r["doc_id"] for r in judged if r["kept"]) == Counter(r["doc_id"] for r in out.collect())


def check_exact(spark, docs, out):
    assert_rows_of(out, docs)
    keep = {}
    for r in docs.collect():
        text, key = r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]
        keep[text] = max(key, keep.get(text, key))
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()) == sorted(keep.items())


def check_near(spark, docs, out):
    assert_rows_of(out, docs)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    group = near_groups([r["text"] for r in rows])
    want = [(r["doc_id"], r["text"]) for i, r in enumerate(rows) if group[i] == i or not WORD.search(r["text"] or "")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def check_mix(spark, docs, out):
    assert out.columns == docs.columns
    rows, mixed = docs.collect(), out.collect()
    size, used = Counter(), Counter()
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    for r in mixed:
        used[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) or r["text"] in {x["text"] for x in rows}
    for s, want in zip(order, shares([size[s] for s in order]), strict=True):
        assert abs(used[s] - want) <= 1
    taken, got = Counter(), Counter()
    for r in mixing.taken(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    text = {}
    for r in rows:
        text.setdefault(r["doc_id"], []).append(WORD.findall(r["text"] or ""))
    for r in mixed:
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert any(not Counter(words) - Counter(x) for x in text[r["doc_id"]])  # words of the document, each at most as often
    assert +got == +taken


def check_bpe(spark, docs, out):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    want = [(r["doc_id"], r["lang"], r["source"], r["n_chars"], library.encode_ordinary(r["text"] or ""), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()]
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


CHECKS = {"quality_rules": check_quality, "exact_dedup": check_exact, "simhash_near_dedup": check_near, "source_mix": check_mix, "byte_bpe": check_bpe}


@pytest.mark.parametrize("name", ["documents", "awkward", "copies", "empty"])
def test_stages_by_brute_force(spark, name):
    docs = stored(tables(spark)[name].toDF(*[re.sub(r"\W", "_", c) for c in tables(spark)[name].columns]))
    for step, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""))
        CHECKS[step](spark, docs, out)
        if name == "empty":
            assert out.count() == 0
        # what a stage drops for good reason would leave little to the others: they get the awkward rows themselves, too
        if name in ("awkward", "copies") and step != "byte_bpe":
            continue
        docs = out


def test_stages_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == list(CHECKS) and len(CLASHING) > 50


def test_run_equals_its_stages_and_tidies_up(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    before = len(left(spark))
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert len(left(spark)) == before + 1  # the result alone stays


def left(spark):
    from quillon.llm.common import shared_dir

    return list(Path(re.sub("^file:/*", "/", shared_dir(spark))).iterdir())
