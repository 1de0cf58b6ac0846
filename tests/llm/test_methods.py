"""The numeric methods beside optima, other algorithms and exact comparisons that they could fail."""

import itertools
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from bagwise.llm import near_dedup, packing, quality_classifier  # noqa: E402
from bagwise.llm.quality_rules import STOP_WORDS  # noqa: E402
from bagwise.llm.queries import QUERIES  # noqa: E402


def least_by_enumeration(a, b):
    """The smallest residual over all sets of free variables whose least squares are not negative."""
    best = float(b @ b)
    for k in range(1, a.shape[1] + 1):
        for free in itertools.combinations(range(a.shape[1]), k):
            x = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (x >= -1e-9).all():
                best = min(best, float(((a[:, free] @ x - b) ** 2).sum()))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_nnls_finds_the_optimum(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(5, 7)), rng.normal(size=5) * 3
    if seed % 2:
        a, b = np.abs(np.round(a)), np.abs(np.round(b))  # like counts
    x = packing.nnls(a, b)
    assert (x >= 0).all()
    assert ((a @ x - b) ** 2).sum() == pytest.approx(least_by_enumeration(a, b), abs=1e-7)
    slope = a.T @ (a @ x - b)
    assert (slope >= -1e-7).all() and np.abs(slope * x).max() < 1e-7


def test_nnls_of_a_full_histogram_meets_its_conditions():
    packer = packing.Packer(packing.PackSettings(), 0)
    counts = np.random.default_rng(5).integers(0, 4000, packer.units - 1).astype(float)
    x = packing.nnls(packer.matrix, counts)
    slope = packer.matrix.T @ (packer.matrix @ x - counts)
    assert (x >= 0).all() and slope.min() >= -1e-7 * counts.sum() and np.abs(slope * x).max() <= 1e-7 * counts.sum() ** 2
    assert (x > 0).sum() > 5


def test_most_windows_come_from_combinations_and_none_is_padded():
    sizes = np.random.default_rng(6).integers(1, 4000, 3000).tolist()
    pieces = packing.Packer(packing.PackSettings(), 0).pack(sizes)
    by = {}
    for doc, start, n, sequence, offset in pieces:
        by.setdefault(sequence, []).append((offset, n))
    lengths = {k: sum(n for _, n in v) for k, v in by.items()}
    mixed = [k for k, v in by.items() if len(v) > 1 and lengths[k] == 1024]
    aligned = [k for k in mixed if all(n % 64 == 0 for _, n in by[k]) and len(by[k]) <= 4]
    assert len(aligned) > 0.8 * len([1 for s in sizes if s % 1024 >= 64]) / 4
    assert sum(n for n in lengths.values() if n < 1024) <= 1023 and sum(lengths.values()) == sum(sizes)


def test_ids_are_those_of_the_tokenizer():
    """Two thousand strings of characters that tokenizers treat in their own ways."""
    from tokenizers import Tokenizer

    path = packing.production_tokenizer()
    plain, own = Tokenizer.from_file(path), packing.Encoder(Path(path).read_text(encoding="utf-8"))
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "'s", "'LL", "don't", "Straße", "日本", "é", "‍", "😀", "१२", "½", "_", "--", "<|endoftext|>", "<|", "a", "Z", "0", "123456", "\x00"]
    for _ in range(2000):
        text = "".join(draw.choices(parts, k=draw.randrange(12)))
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def plain_statistics(text):
    words = (text or "").encode().split()
    if not words:
        return [0.0] * 21
    data, n = text.encode(), len(words)
    lines = [x for x in data.split(b"\n") if x.split()]
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    share = lambda chars: sum(b in chars for b in data)
    letters = sum(chr(b).isalpha() and b < 128 for b in data) or 1
    shares = [k / len(data) for k in Counter(data).values()]
    stops = {w.encode() for w in STOP_WORDS}
    return [
        np.log(1 + len(data)), np.log(1 + n), np.log(1 + len(lines)), mean, (sum((s - mean) ** 2 for s in sizes) / n) ** 0.5,
        sum(s <= 3 for s in sizes) / n, sum(s >= 12 for s in sizes) / n, sum(w.lower() in stops for w in words) / n,
        len(set(words)) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), max(Counter(words).values()) / n,
        len(set(lines)) / len(lines), np.log(1 + n / len(lines)), sum(65 <= b < 91 for b in data) / letters,
        sum(48 <= b < 58 for b in data) / len(data), share(b"#*$%&|<>") / n, share(b"!?") / n, share(b".") / n, share(b",") / n,
        sum(b > 127 for b in data) / len(data), -sum(p * np.log2(p) for p in shares),
    ]


def isotonic_by_minima(good, n):
    """The least of the largest means: another way to the same regression."""
    mean = lambda i, j: good[i : j + 1].sum() / n[i : j + 1].sum()
    return [max(min(mean(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]


def test_classifier_as_restated(spark):
    """Statistics, kernel features, ridge solution, calibration and scores of a whole table."""
    folder, s = "/root/testdata/sf0.01", quality_classifier.ClassifierSettings()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    ids = sorted(texts)
    x = np.array([plain_statistics(texts[i]) for i in ids])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    y = np.array([labels.get(i, np.nan) for i in ids], float)
    known = ~np.isnan(y) & (fold != 0)
    fitted, rest = known & (fold != 4), known & (fold == 4)
    mean, spread = x[fitted].mean(axis=0), x[fitted].std(axis=0)
    rng = np.random.default_rng(s.seed)
    w, b = rng.normal(size=(21, s.features)) * np.sqrt(2 / 21), rng.uniform(0, 2 * np.pi, s.features)
    scaled = np.clip((x - mean) / np.where(spread > 1e-9, spread, 1), -6, 6)
    z = np.column_stack([np.sqrt(2 / s.features) * np.cos(scaled @ w + b), np.ones(len(x))])
    # Ridge as least squares with further rows, the constant unpenalised.
    extra = np.sqrt(s.ridge * fitted.sum()) * np.eye(s.features + 1)[:-1]
    beta = np.linalg.lstsq(np.vstack([z[fitted], extra]), np.r_[y[fitted], np.zeros(s.features)], rcond=None)[0]
    raw = np.clip(z @ beta, -1, 2)
    bins = np.floor((raw + 1) / 3 * 2000).astype(int)
    found = np.unique(bins[rest])
    n = np.array([(rest & (bins == k)).sum() for k in found])
    good = np.array([y[rest & (bins == k)].sum() for k in found])
    level = np.round(isotonic_by_minima(good, n), 12)
    centre = -1 + (found + 0.5) * 3 / 2000
    pools = [level == v for v in sorted(set(level))]
    knots = [(centre[p] * n[p]).sum() / n[p].sum() for p in pools], [level[p][0] for p in pools]
    score = 0.999 * np.interp(raw, *knots) + 0.001 * (raw + 1) / 3
    rows = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, folder).collect()}
    assert sorted(rows) == ids
    edge = np.abs((raw + 1) / 3 * 2000 - np.round((raw + 1) / 3 * 2000)) < 1e-6  # a rounding error from another bin
    assert not (edge & rest).any()
    np.testing.assert_allclose([rows[i].score for i in ids], score, atol=1e-6)
    assert [rows[i].held_out for i in ids] == (fold == 0).tolist()
    sure = np.abs(score - 0.3) > 1e-6
    assert all(rows[i].predicted == int(v >= 0.3) for i, v, ok in zip(ids, score, sure) if ok)


def test_no_link_of_the_queries_is_lost(spark):
    """Every fiftieth document against all rows: brute force over shared shingles, at ten thousand documents."""
    folder = "/root/testdata/sf0.1"
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())
    shingler = near_dedup.Shingler(5)
    sets = {i: frozenset(shingler(t).tolist()) for i, t in texts.items()}
    holders = {}
    for i, found in sets.items():
        for h in found:
            holders.setdefault(h, []).append(i)
    links = set()
    for i in (i for i in sets if i % 50 == 0):
        met = Counter(j for h in sets[i] for j in holders[h])
        for j, common in met.items():
            if j != i and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                links.add((i, j))
    component = {r.doc_id: r.component_id for r in QUERIES["op10_near_dedup"](spark, folder).collect()}
    assert len(links) > 50 and all(component[i] == component[j] for i, j in links)
    assert all(component[i] <= i for i in component)
