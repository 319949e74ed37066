import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowscope.llm import op11_merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """All levels from the leaves to the top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    runs = []
    for level in levels[:-1]:
        first = at - at % fanout
        runs.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return runs


def brute(rows, fanout):
    """(leaf, subroot, root, path) of every (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([d for *_, d in sorted(groups[g])], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    return [(trees[g][0][i], trees[g][-1][0], top[-1][0], path(trees[g], i, fanout) + path(top, names.index(g), fanout)) for g in names for i in range(len(trees[g][0]))]


def found(df, **settings):
    return [(r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in M.manifest(df, **settings).collect()]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit("x"), "tree": F.lit(3), "item": F.lit(None).cast("string")})


@pytest.mark.parametrize(("fanout", "depth", "n"), [(2, 4, 61), (2, 1, 9), (3, 2, 40), (5, 1, 26)])
def test_brute_force(spark, fanout, depth, n):
    rng = random.Random(n)
    rows = [(rng.randrange(n), rng.choice("ab"), rng.choice([None, "de", "en", "en", "en", "é", "z"]), rng.choice([None, 7]), rng.choice([None, "", "t" * rng.randrange(9)])) for _ in range(n)]
    assert sorted(found(table(spark, rows), fanout=fanout, depth=depth)) == sorted(brute(rows, fanout))


def test_defined_cases(spark):
    long = "é" * 200_000
    rows = [(None, None, None, None, None), (1, "s", "en", 3, long), (1, "s", "en", 3, long), (1, "s", "en", 3, "other"), (2, "", "", 0, "")]
    assert sorted(found(table(spark, rows))) == sorted(brute(rows, 2))
    one = found(table(spark, rows[:1]))
    assert one == [(leaf(rows[0]),) * 3 + ([],)]
    assert found(table(spark, [])) == []


def test_hot_group_and_copies(spark):
    rows = [(5, "s", "en", 1, "same")] * 300 + [(i, "s", "en", 1, "x") for i in range(200)] + [(i, "s", f"l{i}", 1, "y") for i in range(40)]
    assert sorted(found(table(spark, rows))) == sorted(brute(rows, 2))


def test_tampered_rows_fail(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i if i % 5 else None, "x") for i in range(50)]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = {r.id: r for r in M.manifest(table(spark, rows), claimed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).collect()}
    expected = {i: zlib.crc32(str(i).encode()) % 7 != 0 or i % 5 == 0 for i in range(50)}
    assert {i: r.verified for i, r in out.items()} == expected
    assert all((r.folded_root == r.root) == r.verified for r in out.values())
