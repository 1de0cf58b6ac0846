"""URL filter: rules first, then the likelihood ratio of two character models.

Rules name a host and the start of a path. URLs that a rule judges train two smoothed Markov models of
variable order, one of accepted and one of rejected URLs. The others are judged by the difference of
their log-likelihoods per character, against a threshold calibrated on judged URLs held out from the
counts. Everything is counted by grouping and looked up by joins of built-in functions.

A URL is split into symbols once, in time linear in its length, and its character groups are numbers that
travel with a 128-bit key, never with the URL. The alphabet is closed, so all groups there can be are
``len(ALPHABET) ** (order + 1)``: that bounds the table of their ratios, which is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import LOOKUP_BYTES, lookup, table
from bagwise.plans.lookup import lookup_join, measured_bytes
from bagwise.plans.scratch import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class ModelSettings:
    """Contexts of up to ``order`` characters, used where seen ``least`` times; ``prior`` characters of smoothing.

    The alphabet is closed (other characters share one symbol), so the model has at most
    ``len(ALPHABET) ** (order + 1)`` entries however many URLs it has seen.
    """

    order: int = 3
    least: int = 20
    prior: float = 4.0


#: The symbols of the models; digits share 0, all else shares ~; ^ starts and ! ends.
KNOWN = "abcdefghijklmnopqrstuvwxyz0./-_?=&%:#"
ALPHABET = KNOWN + "~^!"


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """The ``value`` of the longest rule that fits; a rule fits its host, all subdomains, and its path onward."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def symbols_of(url: Column, order: int) -> Column:
    """The URL in the models' alphabet, with its start and end."""
    low = F.translate(F.lower(url), "123456789", "000000000")
    known = "".join("\\" + c if c in "./-?%#" else c for c in KNOWN)
    return F.concat(F.lit("^" * order), F.regexp_replace(low, f"[^{known}]", "~"), F.lit("!"))


def _codes(symbols: Column, order: int) -> Column:
    """Each symbol with the ``order`` before it, as one number in base ``len(ALPHABET)``; in order."""
    base = len(ALPHABET)
    digits = F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: (F.position(c, F.lit(ALPHABET)) - 1).cast("long"))

    def joined(all_digits: Column) -> Column:
        n = F.greatest(F.size(all_digits) - order, F.lit(0))
        out = F.slice(all_digits, F.lit(1), n)
        for later in range(1, order + 1):
            out = F.zip_with(out, F.slice(all_digits, F.lit(later + 1), n), lambda a, b: a * base + b)
        return out

    # One element stands for a variable: the symbols are split once.
    return F.flatten(F.transform(F.array(digits), joined))


def _gram(code: Column, order: int) -> Column:
    """The symbols of a code."""
    base = len(ALPHABET)
    letters = [F.substr(F.lit(ALPHABET), (F.floor(code / base**at) % base + 1).cast("int"), F.lit(1)) for at in range(order, -1, -1)]
    return F.concat(*letters)


def _spread(urls: DataFrame) -> DataFrame:
    """The URLs over all tasks: a short table makes long work once its URLs are taken apart."""
    context = urls.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return urls.repartition(tasks, "_key")


def character_models(judged: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """The entries of both models: ``gram, pa, pb`` for every kept context followed by every symbol.

    A probability mixes the counts after a context with the probability after the context without its
    first character, down to equal chances. A context is kept if both models together saw it often
    enough; then so are all shorter ones.
    """
    k, beta = settings.order, settings.prior
    is_a = F.col("_verdict") == "allow"
    codes = judged.select(is_a.alias("_a"), F.explode(_codes(F.col("_symbols"), k)).alias("_code"))
    counts = codes.groupBy("_code").agg(F.count_if("_a").alias("na"), F.count_if(~F.col("_a")).alias("nb"))
    full = stored(counts.select(_gram(F.col("_code"), k).alias("_gram"), "na", "nb"), "grams")
    letters = F.explode(F.array(*[F.lit(c) for c in ALPHABET])).alias("c")
    lower, entries = None, []
    for n in range(k + 1):
        grams = full.groupBy(F.substr("_gram", F.lit(k + 1 - n)).alias("gram")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        context = F.substr("gram", F.lit(1), F.lit(n))
        totals = grams.groupBy(context.alias("context")).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
        totals = totals if n == 0 else totals.where(F.col("ta") + F.col("tb") >= settings.least)
        if n == 0:
            totals = judged.sparkSession.createDataFrame([("",)], "context string").join(totals, "context", "left")
        cells = totals.select("*", letters).withColumn("gram", F.concat("context", "c"))
        cells = cells.join(grams, "gram", "left")
        if lower is None:
            cells = cells.withColumns({"qa": F.lit(1 / len(ALPHABET)), "qb": F.lit(1 / len(ALPHABET))})
        else:
            shorter = lower.select(F.col("gram").alias("_short"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            cells = cells.join(shorter, F.substr("gram", F.lit(2)) == F.col("_short"))

        def smoothed(x: str, cells=cells) -> Column:
            seen, total = F.coalesce(f"n{x}", F.lit(0)), F.coalesce(f"t{x}", F.lit(0))
            return ((seen + beta * F.col(f"q{x}")) / (total + beta)).alias(f"p{x}")

        lower = stored(cells.select("gram", smoothed("a"), smoothed("b")), "model")
        entries.append(lower)
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return out


def gram_ratios(urls: DataFrame, model: DataFrame, settings: ModelSettings) -> DataFrame:
    """``_code, v`` of every group of symbols in the URLs: ln(accepted / rejected) after the longest kept context."""
    entries = stored(model.select("gram", F.ln(F.col("pa") / F.col("pb")).alias("v")), "ratios")
    size = measured_bytes(entries)
    seen = urls.select(F.explode(_codes(F.col("_symbols"), settings.order)).alias("_code")).distinct()
    rows = seen.withColumn("_gram", _gram(F.col("_code"), settings.order))
    found = []
    for n in range(settings.order, -1, -1):
        keyed = entries.where(F.length("gram") == n + 1).select(F.col("gram").alias(f"_g{n}"), F.col("v").alias(f"_v{n}"))
        rows = rows.withColumn(f"_g{n}", F.substr("_gram", F.lit(settings.order + 1 - n)))
        rows = lookup_join(rows, keyed, [f"_g{n}"], budget=LOOKUP_BYTES, table_bytes=size)
        found.append(F.col(f"_v{n}"))
    return rows.select("_code", F.coalesce(*found).alias("v"))


def score_urls(urls: DataFrame, model: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """``_key, score``: mean over the symbols of a URL of their ratios."""
    spread = _spread(urls.select("_key", "_symbols"))
    ratios = stored(gram_ratios(spread, model, settings), "ratios")
    rows = spread.select("_key", F.explode(_codes(F.col("_symbols"), settings.order)).alias("_code"))
    # At most len(ALPHABET) ** (order + 1) rows of two numbers.
    return rows.join(F.broadcast(ratios), "_code").groupBy("_key").agg((F.sum("v") / F.count(F.lit(1))).alias("score"))


def calibrated(scores: DataFrame) -> float:
    """Where held-out accepted and rejected URLs are equally many deviations away; 0 if one kind is missing."""
    s = {
        r["_verdict"]: (r["m"], r["d"])
        for r in scores.groupBy("_verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).collect()
    }
    if not {"allow", "block"} <= s.keys():
        return 0.0
    (ma, da), (mb, db) = s["allow"], s["block"]
    return (ma * db + mb * da) / (da + db) if da + db > 0 else (ma + mb) / 2


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    URLs are judged once each, however many pages share them. A null URL is judged as an empty one, with
    empty host and path. Without judged URLs of both kinds the models agree and the verdict is allow.
    """
    distinct = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    parts = distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stored(
        parts.select(
            "*",
            F.unhex(F.md5("url")).alias("_key"),
            rule_of(F.col("host"), F.col("path"), rules, "name").alias("rule"),
            rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("_verdict"),
            symbols_of(F.col("url"), settings.order).alias("_symbols"),
            # One judged URL in four is held out of the counts, for the threshold.
            F.substr(F.md5("url"), F.lit(1), F.lit(1)).isin("0", "1", "2", "3").alias("_held_out"),
        ),
        "urls",
    )
    judged = urls.where(F.col("_verdict").isNotNull())
    model = character_models(_spread(judged.where(~F.col("_held_out"))), settings)
    scores = stored(score_urls(urls, model, settings), "scores")
    scored = stored(urls.drop("_symbols", "url").join(scores, "_key"), "scored")
    limit = calibrated(scored.where(F.col("_verdict").isNotNull() & F.col("_held_out")))
    verdict = F.coalesce("_verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    told = scored.select("_key", "host", "path", "rule", verdict.alias("verdict"), "score")
    rows = pages.select("page_id", F.unhex(F.md5(F.coalesce("url", F.lit("")))).alias("_key"))
    return lookup(rows, told, ["_key"]).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: tuple[Rule, ...] = RULES, settings: ModelSettings = ModelSettings()) -> str:
    """Rules, counts, models, threshold and verdicts in SQL."""
    k, beta = settings.order, settings.prior

    def cases(value: str) -> str:
        whens = [
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
            for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
        ]
        return f"CASE {' '.join(whens)} END"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = "".join("\\" + c if c in "./-?%#" else c for c in KNOWN)
    models = []
    for n in range(k + 1):
        models.append(f"""
c{n} AS (SELECT substr(gram, {k + 1 - n}) AS gram, sum(na) AS na, sum(nb) AS nb FROM full_grams GROUP BY 1),
t{n} AS (SELECT substr(gram, 1, {n}) AS context, sum(na) AS ta, sum(nb) AS tb FROM c{n} GROUP BY 1
         {f'HAVING ta + tb >= {settings.least}' if n else "UNION ALL SELECT '', 0, 0 WHERE NOT EXISTS (FROM c0)"}),
m{n} AS (SELECT context || c AS gram,
                (coalesce(na, 0) + {beta}::DOUBLE * {'lo.pa' if n else f'{1 / len(ALPHABET)!r}::DOUBLE'}) / (ta + {beta}::DOUBLE) AS pa,
                (coalesce(nb, 0) + {beta}::DOUBLE * {'lo.pb' if n else f'{1 / len(ALPHABET)!r}::DOUBLE'}) / (tb + {beta}::DOUBLE) AS pb
         FROM t{n} CROSS JOIN letters LEFT JOIN c{n} ON c{n}.gram = context || c
         {f'JOIN m{n - 1} lo ON lo.gram = substr(context || c, 2)' if n else ''})""")
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.gram = substr(g, {k + 1 - n})" for n in range(k + 1))
    ratio = "coalesce(" + ", ".join(f"ln(m{n}.pa / m{n}.pb)" for n in range(k, -1, -1)) + ")"
    return rf"""
WITH parts AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT coalesce(url, '') AS url FROM pages)),
urls AS (
  SELECT *, {cases('name')} AS rule, {cases('verdict')} AS verdict,
         '{'^' * k}' || regexp_replace(translate(lower(url), '123456789', '000000000'), '[^{known}]', '~', 'g') || '!' AS symbols,
         substr(md5(url), 1, 1) IN ('0', '1', '2', '3') AS held_out
  FROM parts),
grams AS (SELECT url, verdict, held_out, substr(symbols, i, {k + 1}) AS g
          FROM (SELECT *, unnest(range(1, length(symbols) - {k - 1})) AS i FROM urls)),
full_grams AS (SELECT g AS gram, sum((verdict = 'allow')::INT) AS na, sum((verdict = 'block')::INT) AS nb
               FROM grams WHERE verdict IS NOT NULL AND NOT held_out GROUP BY g),
letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
{",".join(models)},
scores AS (SELECT url, avg({ratio}) AS score FROM grams {joins} GROUP BY url),
stats AS (SELECT avg(score) FILTER (verdict = 'allow') AS ma, stddev_pop(score) FILTER (verdict = 'allow') AS da,
                 avg(score) FILTER (verdict = 'block') AS mb, stddev_pop(score) FILTER (verdict = 'block') AS db
          FROM scores JOIN urls USING (url) WHERE verdict IS NOT NULL AND held_out),
threshold AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db)
                          ELSE (ma + mb) / 2 END AS t FROM stats)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN urls ON urls.url = coalesce(pages.url, '') JOIN scores ON scores.url = urls.url, threshold
"""
