"""Conversation repair, centroid clustering and license scans against brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from hedgeline.llm import centroids, licenses, queries, repair
from hedgeline.llm.common import Scratch

from ..compare import of_duckdb, of_spark

SMALL = "/root/testdata/sf0.001"
ALLOWED = re.compile("(s?(ua)+)?")


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_centroid_clustering", "op13_license_scan"])
def test_queries_equal_their_sql(spark, name):
    assert of_spark(queries.QUERIES[name](spark, SMALL)) == of_duckdb(queries.ORACLES[name], SMALL)


# Conversation repair


def outcome(letters: str, audit: str) -> tuple[int, str] | None:
    """Cost and roles that an audit leads to, None where it can't be applied."""
    cost, roles, rows = 0, "", iter(letters)
    for edit in audit:
        forced = "a" if roles.endswith("u") else "u"
        if edit == "I":
            cost, roles = cost + 3, roles + forced
            continue
        row = next(rows)
        if edit == "D":
            cost += 4
        elif row == "x":
            return None
        else:
            cost += 3 * row.isupper() + 3 * (edit == "R")
            roles += row.lower() if edit == "K" else forced
    return (cost, audit) if ALLOWED.fullmatch(roles) else None


def cheapest(letters: str) -> tuple[int, str]:
    """By trying every audit with up to two insertions before each row and at the end."""
    gaps = itertools.product(("", "I", "II"), repeat=len(letters) + 1)
    tries = ("".join(a + b for a, b in itertools.zip_longest(gap, edits, fillvalue="")) for gap in gaps for edits in itertools.product("KRD", repeat=len(letters)))
    return min(found for audit in tries if (found := outcome(letters, audit)))


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4])
def test_signatures_are_solved_at_the_least_cost(size):
    rng = random.Random(size)
    every = ["".join(p) for p in itertools.product("suaoSUAOx", repeat=size)]
    for letters in every if size < 3 else rng.sample(every, 60 if size == 3 else 12):
        solved = repair.Signature(letters)
        assert (solved.cost(0, repair.START), solved.audit()) == cheapest(letters), letters


def test_a_very_long_signature():
    letters = "".join(random.Random(1).choices("suaUAx", k=20_000))
    solved = repair.Signature(letters)
    audit, cost = solved.audit(), solved.cost(0, repair.START)
    assert outcome(letters, audit) == (cost, audit)
    # costs add up where a whole conversation follows another
    assert repair.Signature("ua" * 5000 + "x" * 300).cost(0, repair.START) == 1200


def repaired_by_hand(rows: list[tuple]) -> dict:
    """rows: conv_id, turn, role, text."""
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {c for c, *_ in rows}:
        damaged = []
        for c, t, r, x in sorted((row for row in clean if row[0] == conv), key=lambda row: (row[1] is not None, row[1] or 0, *row[2:])):
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
            damaged += [(t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
        damaged.sort(key=lambda row: (row[0] is not None, row[0] or 0, *row[1:]))
        letters, seen, counts = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, r, x in damaged:
            body = x.strip(repair.SPACE)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            own = r[:1] if r[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
        turns = [t for t, *_ in damaged if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in damaged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = cheapest(letters)
        text, before, remaining = [], "", iter(damaged)
        for edit in audit:
            forced = "assistant" if before == "u" else "user"
            _, r, x = (None, forced, "") if edit == "I" else next(remaining)
            if edit != "D":
                r = r if edit == "K" else forced
                text.append(f"{r}:{x}")
                before = r[0]
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def test_conversations_are_repaired(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["A question?", "An answer.", "cut short", " \t\n", "", None, "x" * 40_000 + ".", "é!", "。"]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(150)] for _ in range(rng.randint(1, 3))]
    rows += [(500, 1, "user", "Same."), (500, 1, "user", "Same."), (501, 10**12, "user", "Hi."), (501, None, "assistant", "Ho."), (-7, -5, "user", "Hi."), (-7, 3, "assistant", "Ho.")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string, letter int, audit string").repartition(6)
    found = repair.digests(df, repair.damaged(df), Scratch(spark, "t")).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in found} == repaired_by_hand(rows) and len(found) == len({c for c, *_ in rows})
    assert repair.digests(df.limit(0), df.limit(0), Scratch(spark, "t")).count() == 0


def test_each_signature_is_solved_once_and_rows_come_out_whole(spark):
    pair = [("user", "Why?"), ("assistant", "So.")]
    rows = [(conv, turn, *row) for conv in range(300) for turn, row in enumerate(pair)] + [(900, i, role, f"Row {i}.") for i, role in enumerate(["assistant", "user", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = repair.audits(df, Scratch(spark, "t"))
    assert {(r["signature"], r["audit"], r["cost"]): r["count"] for r in found.groupBy("signature", "audit", "cost").count().collect()} == {("ua", "KK", 0): 300, ("auua", *reversed(cheapest("auua"))): 1}
    out = [tuple(r) for r in repair.repaired(df, found).where("conv_id = 900").orderBy("place").collect()]
    kept = [(e, row) for e, row in zip(found.where("conv_id = 900").first()["audit"].replace("I", ""), rows[-4:], strict=True) if e != "D"]
    assert [r[4] for r in out if r[2] != "I"] == [row[3] for _, row in kept] and ALLOWED.fullmatch("".join(r[3][0] for r in out))


# Centroid clustering


def clustered(rows: list[tuple], size: int, k: int, rounds: int) -> dict:
    """vec_id, embedding: the whole procedure in Python's integers."""
    good = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [q for _, q in named[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    place = lambda q: min((far(q, c), j) for j, c in enumerate(at))[::-1]
    for _ in range(rounds):
        groups = {}
        for _, q in good:
            groups.setdefault(place(q)[0], []).append(q)
        at = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    out, sums = [], {}
    for i, q in good:
        j, d = place(q)
        out.append((i, j, min(d, centroids.LONGEST)))
        sums[j] = sums.get(j, 0) + out[-1][2]
    long = lambda v: min(v, centroids.LONGEST)
    return sorted(((i, j, d, long(sums[j]), long(sum(sums.values())), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def found_clusters(df, **more) -> list:
    out = centroids.digests(centroids.cluster(df, Scratch(df.sparkSession, "t"), centroids.Settings(**more)))
    return sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


ODD = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [0.0] * 8), (None, [0.25] * 8), (None, [0.25] * 8)]
SCHEMA = "vec_id bigint, embedding array<double>"


def test_clusters_equal_whole_numbered_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 8) / 4 + rng.normal(0, 0.01, 8) * (i % 2)).tolist()) for i in range(250)]
    rows += rows[:40] + [(500 + i, rows[7][1]) for i in range(30)] + ODD  # repeated rows, equal vectors under other names
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, point string").repartition(5)
    assert found_clusters(df, size=8, rounds=4) == clustered(rows, 8, 8, 4)
    assert found_clusters(df.limit(0), size=8) == []
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert found_clusters(few, size=8) == clustered(rows[:3], 8, 8, 10)


def test_clusters_of_huge_components(spark):
    rows = [(i, [float(i % 3), 2.0**40 * (i % 2), -1e9]) for i in range(20)] + [(50, [1e300, -1e308, 0.5]), (51, [1e300, -1e308, 0.25])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_clusters(df, size=3, clusters=3, rounds=3) == clustered(rows, 3, 3, 3)


def test_intervals_hold_the_true_distance_and_leave_out_most():
    rng = np.random.default_rng(6)
    settings = centroids.Settings()
    at = [tuple(int(v) for v in rng.integers(-300, 300, 64)) for _ in range(8)]
    at[5] = at[2]  # a tie for every point
    points = rng.integers(-(1 << 20), 1 << 20, (500, 64))
    points[:200] = rng.integers(-300, 300, (200, 64))
    points[0] = (np.array(at[0]) + np.array(at[1])) // 2
    whole = centroids.Centroids(at, settings)
    exact = ((points[:, None, :] - whole.exact[None]) ** 2).sum(axis=2)
    may = whole.shortlist(points)
    assert may[np.arange(500), exact.argmin(axis=1)].all()
    assert (whole.screened(points) == exact.argmin(axis=1)).all()
    assert may[:200].sum(axis=1).mean() < 2
    assert dict(centroids.digits(-5)) == {0: -5}
    for total in (0, -1, 1 << 39, -(1 << 41), 3**90, -(3**90)):
        assert sum(v << (centroids.DIGIT * p) for p, v in centroids.digits(total)) == total


# License scans


def test_templates_are_accepted_whatever_fills_their_regions():
    automaton = licenses.Automaton(["a [b [c]] d|e {2} f", "d f"])
    accepted = lambda text: [(t, a, b) for t, a, b in scanned(automaton, text)]
    assert accepted("a d f") == [(0, 0, 3), (1, 1, 3)]
    assert accepted("x a b c e 1 2 f") == [(0, 1, 8)]
    assert accepted("a c d f") == [(1, 2, 4)]
    assert accepted("a d 1 2 3 f") == []
    assert accepted("a a b d f f") == [(0, 1, 5), (0, 1, 6), (1, 3, 5)]
    for wrong in ("[a", "a ]", "{2} a", "[a]", "a } b", "a {2 b"):
        with pytest.raises(ValueError):
            licenses.Automaton([wrong])


def scanned(automaton, text: str, size: int = licenses.PIECE) -> list:
    one = licenses.Scan(automaton)
    for words in licenses.pieces(text.encode(), size):
        one.read(words)
    return sorted(one.found)


def test_templates_equal_regular_expressions():
    rng = random.Random(8)
    markups = ["a b", "a [b c] {2} d", "[a] b [[c] d] a", "b|c {3} [a] d", "a a b"]
    automaton = licenses.Automaton(markups)
    for _ in range(300):
        text = " ".join(rng.choices("abcd", k=rng.randint(0, 14)))
        line = f" {text} "
        expected = {t for t, markup in enumerate(markups) if re.search(licenses.as_regex(markup), line)}
        assert {t for t, *_ in scanned(automaton, text)} == expected
        assert scanned(automaton, text, 3) == scanned(automaton, text)  # in pieces of three bytes


def test_licenses_of_odd_documents(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    texts = {
        1: None, 2: "", 3: " \n,;", 4: "MIT License", 5: "mit,license MIT\nLICENSE permit license", 6: "mitlicense émit license mit licenseé", 7: mit, 8: mit.replace("substantial", "important"), 9: mit.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME Ltd"),
        10: "x " * 400_000 + "GNU General Public License" + " y" * 10, 11: "Copyright (c) 1999-2004 The Example Authors. All rights reserved.", 12: "This work is licensed under the GNU General Public License, version 3.", 13: "z" * 3_000_000 + " Apache License", 14: "İMIT LICENSE",
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(None, "MIT license", "x", 1), (4, "MIT License", "x", 1)], "doc_id bigint, text string, spans string, n_words int")
    out = [tuple(r) for r in licenses.digests(licenses.scan(df)).collect()]
    rows = {r[0]: r[1:] for r in out}
    assert len(out) == len(texts) + 2 and rows[None] == (2, 1, 0, 0, "mit", "mit", 0.5)
    empty = (0, None, None, "", "", 0.0)
    assert rows[1] == rows[2] == rows[3] == (0, *empty)
    assert rows[4] == (2, 1, 0, 0, "mit", "mit", 0.5) and rows[5] == (6, 2, 0, 2, "mit", "mit", 0.5) and rows[6] == (5, *empty)
    assert rows[7][4:] == ("", "mit", 1.0) and rows[8][4:] == ("", "", 0.0) and rows[9][4:] == ("", "mit", 1.0)
    assert rows[10] == (400_014, 1, 400_001, 400_001, "gpl", "gpl", 0.5)
    assert rows[11][4:] == ("", "all-rights-reserved", 1.0) and rows[12] == (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0)
    assert rows[13] == (3, 1, 1, 1, "apache", "apache", 0.5) and rows[14] == (2, *empty)
    (spans,) = [r["spans"] for r in licenses.scan(df.where("doc_id = 12")).collect()]
    assert sorted((s["label"], s["start"], s["stop"], s["base"]) for s in spans) == [("gpl", 7, 10, True), ("gpl-3.0", 0, 12, False)]
    assert licenses.scan(df.limit(0)).count() == 0
