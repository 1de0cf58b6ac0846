"""Line dedup, centroid clustering and the source audit on small tables, beside plain restatements."""

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from bagwise.llm import centroids, line_dedup, source_audit  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, kept boolean, key string, pos int, n_lines int, z long"
COMMON = "  A line that Many documents SHARE \t"
SHORT = "too short to count"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "k", 1, 7, 2) for i, t, lang, s in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_lines(rows, least_chars=20, least_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        goes = lambda k: len(k) >= least_chars and len(holders[k]) >= least_docs and i != max(h for h in holders[k] if h is not None)
        stay = [line for line in lines if not goes(key(line))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


LINES = [
    (1, f"{COMMON}\nown\n{COMMON}\n\n"),
    (2, f"{COMMON.lower()}\n{SHORT}"),
    (3, f"x\n{COMMON}\n{COMMON.strip()}\ny\n{SHORT}"),
    (3, f"x\n{COMMON}\n{COMMON.strip()}\ny\n{SHORT}"),
    (3, f"another text of this id\n{COMMON}"),
    (4, f"{SHORT}\nline of two documents only"),
    (5, "line of two documents only"),
    (5, "line of two documents only"),
    (None, f"{COMMON}\nnull id"),
    (None, None),
    (6, ""),
    (7, None),
    (8, "\n".join(f"{COMMON} {i % 7}" for i in range(20_000)) + "\n" + "one very long line " * 20_000),
    (9, "\n".join(f"{COMMON} {i}" for i in range(5))),
    (10, f"{COMMON} 3\nÄ {COMMON}\n" + "İ" * 20),
]


def test_lines(spark):
    docs = made(spark, [(i, t, "en", "s") for i, t in LINES])
    out = line_dedup.without_common_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = out.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=str) == plain_lines(LINES)
    assert {(r.key, r.pos, r.z) for r in rows} == {("k", 1, 2)}
    assert line_dedup.without_common_lines(docs.where("false")).count() == 0


def test_lines_under_other_settings_and_partitions(spark):
    docs = made(spark, [(i, t, "en", "s") for i, t in LINES]).repartition(7, "doc_id", "text")
    out = line_dedup.without_common_lines(docs, line_dedup.LineSettings(least_chars=1, least_docs=2))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == plain_lines(LINES, 1, 2)


def test_lines_without_python(spark):
    plan = line_dedup.without_common_lines(made(spark, [(1, "a\nb", "", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_clusters(rows, s):
    """Starts, rounds and means by the contract, with Python's integers and all distances."""
    whole = lambda v: int(v) * s.scale if abs(v) >= 2**53 else math.floor(v * s.scale)
    kept = [(i, [whole(v) for v in x]) for i, x in rows if x is not None and len(x) == s.components and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: (i is None, hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest())
    at = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[: s.k]]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(at)), key=lambda c: (away(x, at[c]), c))
    for _ in range(s.rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[nearest(x)].append(x)
        at = [[sum(v) // len(of[c]) for v in zip(*of[c])] if c in of else old for c, old in enumerate(at)]
    found = [(i, nearest(x), away(x, at[nearest(x)])) for i, x in kept]
    by = Counter()
    for _, c, d in found:
        by[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()
    return sorted(((i, c, d, by[c], sum(by.values()), name(c)) for i, c, d in found), key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 5, 1) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance int")


def clusters(spark, rows, s, kind="double"):
    return sorted(map(tuple, centroids.clustered(vectors(spark, rows, kind), s).collect()), key=str)


def test_clusters(spark):
    s = centroids.ClusterSettings(k=4, components=3, rounds=3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 3) / 64).tolist()) for i in range(60)]  # many ties and repeats
    rows += rows[:5] + [(None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.25]), (None, [0.5, 0.5, 0.5])]
    odd = [(70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0]), (74, [1.0, math.nan, 2.0]), (75, [math.inf, 0.0, 0.0])]
    assert clusters(spark, rows + odd, s) == plain_clusters(rows, s)
    assert clusters(spark, [], s) == [] and clusters(spark, odd, s) == []
    assert clusters(spark, rows[:2], s) == plain_clusters(rows[:2], s)  # fewer vectors than centroids


def test_clusters_that_start_equal(spark):
    """Equal centroids: the smaller number takes all, the other one stays empty where it is."""
    s = centroids.ClusterSettings(k=3, components=2, rounds=2)
    rows = [(i, [1.0, 1.0]) for i in range(4)]
    got = clusters(spark, rows, s)
    assert got == plain_clusters(rows, s) and {r[1] for r in got} == {0}


def test_clusters_of_large_components(spark):
    """Beyond what doubles hold exactly, and beyond what a long holds."""
    s = centroids.ClusterSettings(k=3, components=2, rounds=2)
    rows = [(i, [float(i * 10**6 + 1 / 256), float(-i)]) for i in range(12)]
    assert clusters(spark, rows, s) == plain_clusters(rows, s)
    far = plain_clusters([*rows, (99, [1e15, 2.0]), (98, [1e15, 1e14])], s)
    got = clusters(spark, [*rows, (99, [1e15, 2.0]), (98, [1e15, 1e14])], s)
    assert [(r[0], r[1], r[5]) for r in got] == [(r[0], r[1], r[5]) for r in far]
    assert all(a == b or a is None and b >= 2**63 for g, f in zip(got, far) for a, b in zip(g, f))
    assert any(r[2] is None for r in got)


def test_tournament_holds_on_ties():
    t = centroids.Tournament([[0, 0], [2, 0], [0, 2], [2, 0]])
    assert t(np.array([[1.0, 0.0], [1.0, 1.0], [3.0, 0.0], [0.0, 1.0]]))[0].tolist() == [0, 0, 1, 0]


def plain_audit(rows, s):
    rows = [(lang or "", source or "", t or "") for _, t, lang, source in rows]
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, t in rows:
        found = terms(t)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= s.least_docs]
        groups = [g for g in counts if g[0] == lang]
        every = sum((counts[g] for g in groups), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + s.unit * (c[t] + s.smoothing) // (n + s.smoothing * len(kept)) for t in kept}

        of, q = {g: p(counts[g]) for g in groups}, p(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pair = [(sum(f(of[g][t], of[h][t]) for t in kept), h[1]) for h in groups if h != g]
            term = [(f(of[g][t], q[t]), t) for t in kept if counts[g][t] and of[g][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))[: s.top if part == "term" else None]
                out += [(lang, g[1], part, item, v, at + 1) for at, (v, item) in enumerate(ranked)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "Épsilon", "x1y", "中文", "rare", "z-eta"]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 9)), ["en", "de"][i % 2], f"s{i % 5}") for i in range(70)]
    rows += [(0, None, "en", "silent"), (0, "", None, None), (None, "12 ;;", "xx", "only"), (1, "alpha", "xx", None), (1, "alpha", "xx", "é")]
    return rows


def test_audit(spark):
    rows = audit_rows()
    s = source_audit.AuditSettings(least_docs=4, top=3)
    docs = made(spark, rows)
    got = sorted(map(tuple, source_audit.audited(docs, s).collect()))
    assert got == plain_audit(rows, s)
    assert sorted(map(tuple, source_audit.audited(docs.repartition(5), s).collect())) == got
    assert source_audit.audited(docs.where("false"), s).count() == 0


def test_audit_with_small_bounds(spark, monkeypatch):
    """Stripes handed on early, long runs of a key folded, few pairs at a time."""
    for name, value in (("UNIT", 40), ("ROWS", 2), ("PAIRS", 3)):
        monkeypatch.setattr(source_audit, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rows = audit_rows()
    s = source_audit.AuditSettings(least_docs=2)
    try:
        assert sorted(map(tuple, source_audit.audited(made(spark, rows), s).collect())) == plain_audit(rows, s)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stripes_of_long_texts():
    text = "Café " * 100 + "x" * 5000 + "-1 "
    rows = source_audit.stripes_of(["en", "de"], ["a", "b"], [text.encode() * 300, b" 12 "]).to_pylist()
    assert [(r["term"], r["docs"], r["counts"]) for r in rows] == [("café", 1, [30000]), ("x" * 5000, 1, [300])]
    assert source_audit.stripes_of(["en"], ["a"], [b""]).num_rows == 0


@pytest.mark.parametrize("count", [0, 5, 10**15])
def test_probabilities_of_large_counts(spark, count):
    s = source_audit.AuditSettings()
    p = source_audit._probability(F.lit(count).cast("long"), F.lit(3 * 10**15).cast("long"), F.lit(7).cast("long"), s)
    assert spark.range(1).select(p).first()[0] == 1 + s.unit * (count + 2) // (3 * 10**15 + 14)
