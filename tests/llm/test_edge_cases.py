"""Nulls, empty and odd texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from bagwise.llm import (  # noqa: E402
    archives,
    chat_format,
    exact_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, _text string"
LONG = " ".join(f"word{i}" for i in range(3000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a  b\tc", "en", "s", 6, True, 1, "x"),
        (2, "a b c", "en", "s", 5, None, 1, "x"),
        (2, "a b c", "en", "s", 5, None, 1, "x"),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "t", 0, False, 2, ""),
        (None, "a b c", "de", None, 5, False, 2, ""),
        (None, None, None, None, None, None, None, None),
        (5, LONG, "fr", "t", len(LONG), True, 3, "y"),
        (6, LONG + " end", "fr", "u", len(LONG) + 4, True, 3, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


LABELS = "doc_id long, quality int, toxic int"


def empty(docs):
    return docs.where(F.lit(False))


def test_exact(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == 9
    one = [r for r in rows if r.keep_id == 1]
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in one) == [(0, 4, False), (1, 4, True), (2, 4, False), (2, 4, False)]
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in rows if r.keep_id == 3) == [(0, 3, False), (3, 3, True), (4, 3, False)]
    assert exact_dedup.exact_groups(empty(docs)).count() == 0
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]


def test_exact_with_colliding_hashes(docs):
    """A hash of one character puts different texts together; bytes keep them apart."""
    weak = lambda t: F.substring(F.md5(t), 1, 1) == "0"
    same = lambda d: sorted(map(str, exact_dedup.exact_groups(docs, d).collect()))
    assert same(lambda t: weak(t).cast("string")) == same(F.md5)


def test_exact_keeps_one_of_rows_that_repeat(spark):
    rows = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (1, "y", "c"), (2, "x", "d")], "doc_id long, text string, more string")
    assert sorted(r.text for r in exact_dedup.keep_exact(rows).collect()) == ["x", "y"]
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_groups(rows).collect()) == [(1, False), (1, True), (1, True), (2, False)]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, 0), (1, None, 0), (None, "no scheme", 0), (2, "HTTP://A.ORG/x?y#z", 0), (3, "http://b.com", 0), (4, "ftp://x.Example.org/es/1", 0)],
        "page_id long, url string, score int",
    )
    rows = url_filter.judge_urls(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 6 and got[1][:3] == ("", "", None) and got[3][:3] == ("b.com", "", None)
    assert got[2] == ("a.org", "/x", "org/", "allow") and got[4] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert all(r.verdict in ("allow", "block") for r in rows)
    assert url_filter.judge_urls(empty(pages)).count() == 0


def test_models_follow_their_urls(spark):
    """Of unjudged URLs, those like the accepted ones pass and those like the rejected ones do not."""
    rows = [(i, f"http://{'nice' if i % 2 else 'spam'}{i % 7}.{'org' if i % 2 else 'com/de'}/page") for i in range(400)]
    rows += [(1000, "http://nice3.net/page"), (1001, "http://spam3.net/de/page")]
    out = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[1000].verdict, out[1001].verdict) == ("allow", "block") and out[1000].rule is None


def test_model_rows_are_distributions(spark):
    judged = spark.createDataFrame([("^^^ab!", "allow"), ("^^^ac!", "block")] * 15, "_symbols string, _verdict string")
    sums = url_filter.character_models(judged).groupBy(F.expr("substr(gram, 1, length(gram) - 1)")).agg(F.sum("pa"), F.sum("pb"))
    assert all(r[1] == pytest.approx(1) and r[2] == pytest.approx(1) for r in sums.collect())


def test_rules(docs):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == 9 and sum(r.n_words == 0 and r.base_failed and not r.kept for r in rows) == 3
    assert quality_rules.judge(empty(docs)).count() == 0


def test_repeated_windows(spark):
    rows = spark.createDataFrame([(1, "a b c a b c d"), (2, "x x x x"), (3, "a b"), (4, "l\nl\n \n\nk\nl")], "doc_id long, text string")
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality_rules.judge(rows).collect()}
    assert got == {1: (6, 0), 2: (4, 0), 3: (0, 0), 4: (0, 2)}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_pseudonyms(spark):
    valid, wrong = "4111 1111-1111 1111", "4111111111111112"
    text = f"Mail jo.Do9@mail.example.com, {valid} {wrong}; 1.2.3.4, 1.2.3.999, 2024-02-29 2023-02-29 31/12/1999 +1 (017) 555-7713 123-45-6789 000-45-6789."
    rows = spark.createDataFrame([(1, text, 0), (2, "again " + text, 0), (3, None, 0), (4, "", 0), (4, "no data", 0)], "doc_id long, text string, n_card int")
    got = {(r.doc_id, r.text is None): r for r in pii.pseudonymise(rows).collect()}
    one, two = got[1, False], got[2, False]
    assert two.text == "again " + one.text and got[3, True].n_card == 0
    assert [one[f"n_{k.name}"] for k in pii.KINDS] == [1, 0, 1, 2, 1, 1, 1]
    for gone in ("jo.Do9", valid, "1.2.3.4,", "2024-02-29", "31/12/1999", "555-7713", "123-45-6789"):
        assert gone not in one.text
    for stays in (wrong, "1.2.3.999", "2023-02-29", "000-45-6789", "@mail.example.com", "+1 ("):
        assert stays in one.text
    card = one.text.split(", ")[1][: len(valid)]
    assert card[4] == " " and card[9] == "-" and luhn(card.replace(" ", "").replace("-", ""))
    assert pii.pseudonymise(rows, "other").where("doc_id = 1").first().text != one.text
    assert pii.pseudonymise(empty(rows)).count() == 0


def test_feistel_permutes(spark):
    pairs = spark.range(12 * 7).select(F.array((F.col("id") % 12).cast("int"), (F.col("id") / 12).cast("int")).alias("d"))
    out = pairs.select(pii.feistel(F.col("d"), F.array(F.lit(12), F.lit(7)), "k", "t").alias("e")).collect()
    assert len({tuple(r.e) for r in out}) == 84 and all(r.e[0] < 12 and r.e[1] < 7 for r in out)


def test_mix(docs):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == 9 and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r._source, []).append(r)
    assert set(by) == {"=s", "=t", "=u", "-"}
    assert all(abs(sum(r.taken for r in g) - g[0].target) <= 1 for g in by.values())
    assert mixing.mixture(empty(docs)).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(empty(docs)).count() == 0


def test_water_filling(spark):
    rows = spark.createDataFrame([(f"={s}", s, n) for s, n in (("a", 10), ("b", 100), ("c", 100))], "_source string, source string, size long")
    got = {r._source: r.target for r in mixing.targets(rows, mixing.Mix()).collect()}
    assert got["=a"] == 20 and got["=b"] == pytest.approx(295 / 3) and got["=c"] == pytest.approx(590 / 3)


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(
        [(5, "http://a/ b\n", "x"), (3, None, "x"), (4, "http://é/", None), (9, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\n"), (7, "u", "\r\n\r\nWARC/1.1\n"), (8, "big", "y" * 300_000)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit(1))
    rows = archives.through_archives(pages, f"{tmp_path}/a").collect()
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == [(3, "response", None, 1), (4, "response", None, 0), (5, "revisit", 3, 1), (7, "response", None, 13), (7, "revisit", 7, 13), (8, "response", None, 300_000), (9, "revisit", 4, 0)]
    assert archives.through_archives(pages, f"{tmp_path}/b", least_bytes=2).where("record_type = 'revisit'").count() == 1
    assert archives.through_archives(empty(pages), f"{tmp_path}/c").count() == 0


def test_arc_versions():
    import io

    for version in (1, 2):
        file = archives.arc_head(version)("f") + archives.arc_record(version, "http://a b", "20210203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n")
        (record,) = archives.read_arc(io.BytesIO(file))
        assert (record.url, record.date, record.body[-5:]) == ("http://a%20b", "20210203040506", b"body\n")
        ((fields, block),) = archives.read_warc(io.BytesIO(archives.convert(record, "D", "p", None)))
        assert fields["warc-date"] == "2021-02-03T04:05:06Z" and block == record.body
    with pytest.raises(ValueError, match="declared length"):
        list(archives.read_arc(io.BytesIO(file[:-8])))


@pytest.mark.parametrize("text", ["", " ", "</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST]", "[", "<", "</s", "\\", "x\n</s>"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "[/ROLE] x", "[\\INST]"])
def test_grammar(role, text):
    out = chat_format.render(role, text)
    assert [t[:2] for t in chat_format.parse(out + out)] == [(role, text)] * 2


@pytest.mark.parametrize("text", ["x", "<s>", "<s>[INST] a", "<s> a </s> b", "<s>[INST]a[/INST]", "<s>[ROLE] a [/ROLE] [INST] "])
def test_grammar_refuses(text):
    with pytest.raises(chat_format.Broken):
        chat_format.parse(text)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, None, None, "z"), (None, 0, "user", "n"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    formatted = chat_format.format_turns(turns)
    got = {r.conv_id: r for r in chat_format.digest_conversations(formatted).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[None].n_turns) == (3, 5, 2, 1)
    texts = chat_format.conversation_texts(formatted, most_chars=30).orderBy("conv_id", "part").collect()
    whole = "".join(r.text for r in texts if r.conv_id == 1)
    assert [t[:2] for t in chat_format.parse(whole)] == [("", "z"), ("user", ""), ("assistant", "b</s>")]
    masked = [chat_format.unescaped(r.text[a:b]) for r in texts if r.conv_id == 1 for a, b in r.loss_spans]
    assert masked == ["b</s>"] and chat_format.digest_conversations(empty(formatted)).count() == 0


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], LABELS)
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.classify(docs, labels.where("false")).collect()
    assert len({r.score for r in none}) == 1 and quality_classifier.classify(empty(docs), labels).count() == 0
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(y) == [0, 0.5, 1] and list(x) == [0, 1.5, 3.5]


def test_features_approximate_the_kernel():
    s = quality_classifier.ClassifierSettings(features=4000)
    k = quality_classifier.Kernel(np.zeros(21), np.ones(21), s)
    a, b = np.random.default_rng(0).normal(size=(2, 1, 21)) / 2
    assert (k(a) @ k(b).T)[0, 0] - 1 == pytest.approx(np.exp(-s.gamma * ((a - b) ** 2).sum()), abs=0.05)


def test_packing(docs):
    rows = packing.pack_documents(docs, packing.production_tokenizer()).collect()
    assert sum(r.length for r in rows if r.doc_id in (3, 4)) == 2 and sum(r.doc_id is None and r.length == r.doc_tokens for r in rows) >= 1
    assert packing.pack_documents(empty(docs), packing.production_tokenizer()).count() == 0


def test_combinations():
    assert all(sum(p) == 16 and len(p) <= 4 for p in packing.combinations(16, 4)) and len(set(packing.combinations(16, 4))) == 63


@pytest.mark.parametrize("text", ["", "a  b\n\n c", "x<|endoftext|>y  <|endoftext|> ", "日本語 it's 123 ...   x\x1c\x1c", "tail \n"])
def test_encoder(text):
    from tokenizers import Tokenizer

    path = packing.production_tokenizer()
    own = packing.Encoder(Path(path).read_text(encoding="utf-8"))
    assert own(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packer_fills_windows():
    sizes = np.random.default_rng(2).integers(1, 3000, 500).tolist()
    pieces = packing.Packer(packing.PackSettings(), 7).pack(sizes)
    assert sum(p[2] for p in pieces) == sum(sizes)
    lengths = {}
    for p in pieces:
        lengths[p[3]] = lengths.get(p[3], 0) + p[2]
    short = [n for n in lengths.values() if n < 1024]
    assert len(short) <= 10 and all(n & (n - 1) == 0 for n in short)


def test_near(docs):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()), key=str)
    assert (1, 1, 1, True) in got and got.count((2, 1, 1, False)) == 2 and (0, 1, 1, False) in got
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (0, 0, None, True) in got
    assert (5, 2996, 5, True) in got and (6, 2997, 5, False) in got
    assert near_dedup.near_groups(empty(docs)).count() == 0
    assert near_dedup.keep_distinct(docs).columns == docs.columns


def test_near_chain_through_unlike_ends(spark):
    """Neighbours of a chain are near, its ends are not: one component all the same."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 14 : i * 14 + 160])) for i in range(12)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (98, 98)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[99] == 98


def test_long_urls_take_time_in_proportion(spark):
    """A URL of a million characters, and what its score must be by the model."""
    long = "http://nice1.net/" + "page/" * 200_000
    rows = [(i, f"http://{'nice' if i % 2 else 'spam'}{i % 7}.{'org' if i % 2 else 'com/de'}/page") for i in range(60)]
    pages = spark.createDataFrame([*rows, (1000, long), (1001, None), (1002, "http://nice1.net/" + "ÄÖ" * 300)], "page_id long, url string")
    begin = time.perf_counter()
    out = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(out) == 63 and out[1000].path == "/" + "page/" * 200_000 and out[1000].score is not None
    assert time.perf_counter() - begin < 90


def test_codes_are_the_groups_of_symbols(spark):
    urls = ["", "a", "http://Ab9.com/x?y=1&z#ü"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.symbols_of(F.col("u"), 3).alias("s"))
    grams = frame.select("s", F.explode(url_filter._codes(F.col("s"), 3)).alias("c")).select("s", url_filter._gram(F.col("c"), 3).alias("g"))
    found = {}
    for r in grams.collect():
        found.setdefault(r.s, []).append(r.g)
    assert found == {s: [s[i : i + 4] for i in range(len(s) - 3)] for (s,) in frame.collect()}


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "date", "decimal(20,0)"])
def test_ids_of_other_types(spark, kind):
    ids = spark.range(3).select(F.lit("2020-01-01").cast("date") if kind == "date" else F.col("id").cast(kind).alias("i"), F.lit("a b").alias("text"))
    docs = ids.toDF("doc_id", "text")
    assert dict(packing.pack_documents(docs, packing.production_tokenizer()).dtypes)["doc_id"] == kind
    assert packing.pack_documents(docs, packing.production_tokenizer()).count() >= 3
    turns = ids.toDF("conv_id", "text").withColumns({"turn": F.lit(1), "role": F.lit("user")})
    formatted = chat_format.format_turns(turns)
    assert {r.n_turns for r in chat_format.digest_conversations(formatted).collect()} == ({3} if kind == "date" else {1})
    assert dict(chat_format.conversation_texts(formatted).dtypes)["conv_id"] == kind


def test_pages_without_numbers_are_refused(spark, tmp_path):
    with pytest.raises(TypeError, match="whole numbers"):
        archives.write_legacy(spark.createDataFrame([("p1", "u", "h")], "page_id string, url string, html string"), str(tmp_path))


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_turns_are_counted_in_joined_texts(spark, size, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_CHARS", size)
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} </s>[INST] of {c}") for c in (1, 2) for t in range(7)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    for r in chat_format.digest_conversations(formatted).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.n_turns == 7 and r.loss_chars == sum(len(x[3]) for x in own if x[2] == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
