"""Line differences replay on random texts, are shortest where Myers decides, and take time near to the length."""

import random
import time

from pyspark.sql import functions as F

from marlstone.functions import clean, diff


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_changes_replay_and_match_lines():
    r = random.Random(2)
    for trial in range(1500):
        letters = "ab" if trial % 3 == 0 else "abcdefghij"
        a, b = ([r.choice(letters) for _ in range(r.randint(0, 14))] for _ in range(2))
        found = diff.matches(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert diff.replayed(a, b, diff.changes(a, b)) == b
        whole = diff._myers(a, b)
        assert len(whole) == longest_common(a, b) and all(a[i] == b[j] for i, j in whole) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(whole, whole[1:]))


def test_long_texts_of_repeated_lines():
    r = random.Random(3)
    a, b = ([r.choice("abc") for _ in range(n)] for n in (4000, 3000))
    assert diff._myers(a, b) is None and diff.replayed(a, b, diff.changes(a, b)) == b
    lines = [f"line {k}" for k in range(60_000)]
    moved = lines[30_000:] + lines[:30_000]
    began = time.process_time()
    for x, y in ((lines, moved), (lines, lines[::-1]), (["same"] * 60_000, ["same", "other"] * 30_000)):
        assert diff.replayed(x, y, diff.changes(x, y)) == y
    assert time.process_time() - began < 20


def test_changes_of_a_column(spark):
    rows = [(1, "a\nb", "a\nc\nd"), (2, None, "x"), (3, "same", "same"), (4, "", None)]
    got = {r.k: r.d for r in spark.createDataFrame(rows, "k int, a string, b string").select("k", clean.line_diff(F.col("a"), F.col("b")).alias("d")).collect()}
    assert (got[1].added, got[1].removed, got[1].ratio) == (2, 1, 0.4) and [tuple(c) for c in got[1].changes] == [("replace", 2, 2, 2, 3)]
    assert got[3].changes == got[4].changes == [] and got[4].ratio == 1.0
