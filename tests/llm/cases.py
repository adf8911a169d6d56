"""Rows that operators must bear: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

from collections import Counter

LONG = " ".join(f"wort{i * 7919 % 4001}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while many other animals watch from behind the old wooden fence near the river"
TEXTS = [
    None, None, "", "", "   \n\t ", "one", "ONE", "two words", "a b c", "ß ü 漢字 😇 é", "tab\tand\nline", "a b", BASE, BASE, BASE + " now", BASE.upper(), LONG, LONG,
    "x " * 400, "line of words here\nline of words here\nother\nline of words here", "# * $ % & | < > symbols", "MIT License and apache  license; GNU General Public License", "\r\n", "a\x00b", "12345 67890", "!!! ??? ...",
]

#: Names that operators give to columns of their own, inside or in their results, and one that needs quoting.
CLASHING = """kept fp size number id ids component target row k h order body sha maybe p q page bits l s limits failed stays n_words cut times length ranges
copy copies part parts keep of e g turn at words start low high block gives m n x y i j open held root near label node lang_pred score labels shard slot slot_
part_ decoded entry tokens title html name source_size taken n_shards text_sha256 group_size keep_id base_failed __key __sha __id __text __n_words __limits __size
__slot __k __row a.b""".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, texts=None):
    """One row per text, some of them twice, and a row that is null in every column."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, None if i % 5 == 0 else ("de", "en")[i % 2], None if i % 7 == 0 else "s%d" % (i % 3), len(t or ""), *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)]
    rows += [rows[i] for i in (1, 9, 12) if i < len(rows)]
    if rows:
        rows.append((None,) * (5 + len(CLASHING)))
    return spark.createDataFrame(rows, SCHEMA)


def assert_rows_of(out, docs, but=()):
    """Every row of ``out`` is one of ``docs``, as often at most, in all columns (less those in ``but``)."""
    names = [c for c in docs.columns if c not in but]
    assert [c for c in out.columns if c not in but] == names
    of = lambda df: Counter(tuple(r[c] for c in names) for r in df.collect())
    left = of(out)
    left.subtract(of(docs))
    assert max(left.values(), default=0) <= 0
