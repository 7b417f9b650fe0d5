"""The Merkle manifest against trees built level by level."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at long, node string, levels string"


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, add: int = 0) -> str:
    n = None if row[3] is None else row[3] + add
    return digest("".join(map(field, (row[0], row[1], row[2], n, row[4]))))


def levels_over(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, siblings, folded root, verified) of rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, levels_over([leaf_of(r) for r in own])
    top = levels_over([trees[lang][1][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        own, low = trees[lang]
        for i, row in enumerate(own):
            folded = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            siblings = []
            for levels, k in ((low, i), (top, place)):
                for level in levels[:-1]:
                    pair = level[k - k % 2 : k - k % 2 + 2]
                    siblings += pair[: k % 2] + pair[k % 2 + 1 :]
                    pair[k % 2] = folded
                    folded = digest("".join(pair))
                    k //= 2
            out.append((row[0], leaf_of(row), low[-1][0], top[-1][0], siblings, folded, folded == top[-1][0]))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, tampered)
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "siblings", "folded_root", "verified").collect()]


def row(i, lang, n=7, text="t", source="s"):
    return (i, source, lang, n, text, 1, "clash", "clash")


@pytest.mark.parametrize("block", [2, 10])
def test_manifest_equals_trees_by_level(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
    rows = [row(i * 37 % 101, "hot", n=i) for i in range(90)]
    rows += [row(200 + i, lang, text=f"é{i}") for lang, n in (("a", 1), ("b", 2), (None, 3), ("ü", 5), ("z", 4), ("", 1)) for i in range(n)]
    got = run(spark, rows)
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [row(None, "en", None, None, None), row(None, None, 3, "", None), row(7, "en", 3, "x" * 300_000), row(7, "en", 3, "x" * 300_000), row(7, "en", 4, ""), row(-5, "en", None, "\x00\n")]
    got = run(spark, rows)
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert run(spark, []) == []
    alone = run(spark, [row(3, None)])
    assert alone == plain_manifest([row(3, None)])
    assert alone[0][4] == []


def test_manifest_finds_what_was_changed_and_nothing_else(spark):
    rows = [row(i, "en" if i % 3 else "de", text=f"text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs, {"text": F.concat("text", F.lit("!"))}, F.col("doc_id") == 31)
    assert [r.doc_id for r in got.where("not verified").collect()] == [31]
