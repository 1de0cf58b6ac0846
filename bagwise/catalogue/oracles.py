"""SQL that each query must agree with, over the same tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from bagwise.catalogue import fixtures as fx
from bagwise.catalogue.queries import BATCHES, CHOSEN_BAG, DIGITS, FOLDS, SAMPLE_FRACTION, SCALED, SEED, TRAIN
from bagwise.functions.losses import FOCAL_ALPHA, FOCAL_GAMMA
from bagwise.operators.model import AttentionModel
from bagwise.plans.training import ADAM_BETAS, ADAM_EPS

R = DIGITS


def _affine(weights, bias, names) -> str:
    terms = " + ".join(f"({float(w)!r}) * {n}" for w, n in zip(weights, names))
    return f"{terms} + ({float(bias)!r})"


EVENTS = """
inst AS (
  SELECT user_id AS bag_id, event_id AS instance_id, value / 100 AS x1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS x2
  FROM events),
bags AS (
  SELECT user_id AS bag_id,
         CAST(max(CASE WHEN event_type = 'purchase' AND value > 150 THEN 1 ELSE 0 END) AS INTEGER) AS label
  FROM events GROUP BY user_id)"""


#: Customers by nation: 25 bags at every size of the tables.
NATIONS = """
inst AS (SELECT c_nationkey AS bag_id, c_custkey AS instance_id, c_acctbal / 10000 AS x1, (c_custkey % 100) / 100 AS x2 FROM customer),
bags AS (SELECT c_nationkey AS bag_id, CAST(max(c_acctbal) + min(c_acctbal) > 9000 AS INTEGER) AS label FROM customer GROUP BY c_nationkey)"""


def _forward(model, hidden: list[str]) -> str:
    """CTEs emb (hidden units), lg (logit), wt (attention) over ``inst``; ``hidden`` are unit expressions."""
    h = ", ".join(f"greatest({e}, 0) AS h{j + 1}" for j, e in enumerate(hidden))
    inner = [f"tanh({_affine(model.att_v[j], model.att_c[j], ['h1', 'h2'])})" for j in range(2)]
    return f"""
emb AS (SELECT bag_id, instance_id, {h} FROM inst),
lg AS (SELECT *, {_affine(model.att_w, model.att_b[0], inner)} AS s FROM emb),
ends AS (SELECT bag_id, max(s) AS top FROM lg GROUP BY bag_id),
ex AS (SELECT lg.*, top, exp(s - top) AS e FROM lg JOIN ends USING (bag_id)),
pool AS (SELECT bag_id, max(top) AS top, sum(e) AS mass, sum(e * h1) / sum(e) AS m1, sum(e * h2) / sum(e) AS m2
         FROM ex GROUP BY bag_id),
lgt AS (SELECT *, {_affine(model.cls_w, model.cls_b[0], ['m1', 'm2'])} AS logit FROM pool),
sc AS (SELECT *, 1 / (1 + exp(-logit)) AS p, CAST(logit >= 0 AS INTEGER) AS pred FROM lgt)"""


def _event_forward() -> str:
    m = fx.EVENT_MODEL
    return _forward(m, [_affine(m.embed_w[j], m.embed_b[j], ["x1", "x2"]) for j in range(2)])


def _scored() -> str:
    return f"WITH {EVENTS}, {_event_forward()}, scored AS (SELECT bag_id, label, p, pred FROM sc JOIN bags USING (bag_id))"


def _gated() -> str:
    m = fx.EVENT_GATED_MODEL
    h = ", ".join(f"greatest({_affine(m.embed_w[j], m.embed_b[j], ['x1', 'x2'])}, 0) AS h{j + 1}" for j in range(2))
    gated = [
        f"tanh({_affine(m.att_v[j], m.att_c[j], ['h1', 'h2'])}) / (1 + exp(-({_affine(m.gate_u[j], m.gate_c[j], ['h1', 'h2'])})))"
        for j in range(2)
    ]
    s = ", ".join(f"{_affine(m.att_w[j], m.att_b[j], gated)} AS s{j + 1}" for j in range(2))
    return f"""WITH {EVENTS},
emb AS (SELECT bag_id, instance_id, {h} FROM inst),
lg AS (SELECT *, {s} FROM emb),
ends AS (SELECT bag_id, max(s1) AS t1, max(s2) AS t2 FROM lg GROUP BY bag_id),
ex AS (SELECT lg.*, exp(s1 - t1) AS e1, exp(s2 - t2) AS e2 FROM lg JOIN ends USING (bag_id)),
pool AS (SELECT bag_id, sum(e1) AS z1, sum(e2) AS z2, sum(e1 * h1) / sum(e1) AS m1, sum(e2 * h2) / sum(e2) AS m2
         FROM ex GROUP BY bag_id)"""


def _auc(source: str, keys: str = "") -> str:
    """Area per group of ``keys`` (a list ending in a comma, or nothing) over ``source`` (label, p)."""
    by = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""SELECT {keys} sum(pos * (upto - neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc
FROM (SELECT *, sum(neg) OVER ({by} ORDER BY p) AS upto
      FROM (SELECT {keys} p, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {keys} p)) {group}"""


def _roc(source: str, keys: str = "", name: str = "") -> str:
    """Points of the curve; as a table expression of that name, or as the final query."""
    by = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""
cnt AS (SELECT {keys} p, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {keys} p),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS nth,
               lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg,
               sum(pos) OVER ({by}) AS all_pos, sum(neg) OVER ({by}) AS all_neg
        FROM cnt WINDOW w AS ({by} ORDER BY p DESC)),
roc AS (
  SELECT {keys} p AS threshold, fp / nullif(all_neg, 0) AS fpr, tp / nullif(all_pos, 0) AS tpr FROM cum
  WHERE nth = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL
  SELECT DISTINCT {keys} CAST('Infinity' AS DOUBLE), 0 / nullif(all_neg, 0), 0 / nullif(all_pos, 0) FROM cum)
""" + (f", {name} AS (SELECT * FROM roc)" if name else f"""
SELECT {keys} round(threshold, {R}) AS threshold, round(fpr, {R}) AS fpr, round(tpr, {R}) AS tpr FROM roc""")


# Training, restated: one set of common table expressions per epoch, parameters in one row per model.

def _plain_gradients(dims: int) -> dict[str, str]:
    """Parameters in the order of a flat model, each with its gradient over a row."""
    embedding = {f"w{j}{d}": f"dh{j} * x{d}" for j in (1, 2) for d in range(1, dims + 1)}
    return {
        **embedding,
        "b1": "dh1",
        "b2": "dh2",
        "v11": "d1 * h1",
        "v12": "d1 * h2",
        "v21": "d2 * h1",
        "v22": "d2 * h2",
        "c1": "d1",
        "c2": "d2",
        "u1": "ds * t1",
        "u2": "ds * t2",
        "ub": "ds",
        "k1": "share * h1",
        "k2": "share * h2",
        "kb": "share",
    }


PLAIN_GRADIENTS = _plain_gradients(2)
GATED_GRADIENTS = {
    **{n: PLAIN_GRADIENTS[n] for n in ("w11", "w12", "w21", "w22", "b1", "b2", "v11", "v12", "v21", "v22", "c1", "c2")},
    "u11": "ds1 * i1",
    "u12": "ds1 * i2",
    "u21": "ds2 * i1",
    "u22": "ds2 * i2",
    "ub1": "ds1",
    "ub2": "ds2",
    "k1": "share1 * h1",
    "k2": "share2 * h2",
    "kb": "share1",
    "g11": "e1 * h1",
    "g12": "e1 * h2",
    "g21": "e2 * h1",
    "g22": "e2 * h2",
    "gc1": "e1",
    "gc2": "e2",
}
LOSSES = {
    "bce": (
        "-(greatest(ln(1 / (1 + exp(-z))), -100))",
        "1 / (1 + exp(-logit)) - label",
    ),
    "focal": (
        f"{FOCAL_ALPHA} * pow(1 / (1 + exp(z)), {FOCAL_GAMMA}) * -ln(1 / (1 + exp(-z)))",
        f"{FOCAL_ALPHA} * (2 * label - 1) * pow(1 / (1 + exp(z)), {FOCAL_GAMMA}) * "
        f"({FOCAL_GAMMA} * ln(1 / (1 + exp(-z))) / (1 + exp(-z)) - 1 / (1 + exp(z)))",
    ),
}


@dataclass(frozen=True)
class Restated:
    """How one kind of scorer is written in SQL: parameters with their gradients, and both passes."""

    model: AttentionModel
    gradients: dict[str, str]
    forward: str  # attention logits of the rows of ``hidden``
    pooled: str  # softmax sums and the logit of a bag, of rows with their bag's largest logits
    tops: str
    backward: str  # slopes of the inner activations, of rows with their bag's sums, down to ``dh1, dh2``
    dims: int = 2

    @property
    def hidden(self) -> str:
        units = ["greatest(" + " + ".join(f"w{j}{d} * x{d}" for d in range(1, self.dims + 1)) + f" + b{j}, 0) AS h{j}" for j in (1, 2)]
        return ", ".join(units)


PLAIN = Restated(
    model=fx.EVENT_MODEL,
    gradients=PLAIN_GRADIENTS,
    forward="""
  SELECT *, u1 * t1 + u2 * t2 + ub AS s, k1 * h1 + k2 * h2 AS unit FROM (
    SELECT *, tanh(v11 * h1 + v12 * h2 + c1) AS t1, tanh(v21 * h1 + v22 * h2 + c2) AS t2 FROM hidden)""",
    tops="max(s) AS top",
    pooled="""max(top) AS top, sum(exp(s - top)) AS mass, sum(exp(s - top) * unit) / sum(exp(s - top)) AS mean,
         sum(exp(s - top) * unit) / sum(exp(s - top)) + max(kb) AS logit""",
    backward="""
    SELECT *, (share * k1 + d1 * v11 + d2 * v21) * (h1 > 0)::INTEGER AS dh1,
              (share * k2 + d1 * v12 + d2 * v22) * (h2 > 0)::INTEGER AS dh2 FROM (
      SELECT *, ds * u1 * (1 - t1 * t1) AS d1, ds * u2 * (1 - t2 * t2) AS d2 FROM (
        SELECT *, share * (unit - mean) AS ds FROM (SELECT *, slope * exp(s - top) / mass AS share FROM joined)))""",
)
GATED = Restated(
    model=fx.EVENT_GATED_MODEL,
    gradients=GATED_GRADIENTS,
    forward="""
  SELECT *, u11 * i1 + u12 * i2 + ub1 AS s1, u21 * i1 + u22 * i2 + ub2 AS s2 FROM (
    SELECT *, t1 * q1 AS i1, t2 * q2 AS i2 FROM (
      SELECT *, tanh(v11 * h1 + v12 * h2 + c1) AS t1, tanh(v21 * h1 + v22 * h2 + c2) AS t2,
             1 / (1 + exp(-(g11 * h1 + g12 * h2 + gc1))) AS q1, 1 / (1 + exp(-(g21 * h1 + g22 * h2 + gc2))) AS q2 FROM hidden))""",
    tops="max(s1) AS top1, max(s2) AS top2",
    pooled="""max(top1) AS top1, max(top2) AS top2, sum(exp(s1 - top1)) AS z1, sum(exp(s2 - top2)) AS z2,
         sum(exp(s1 - top1) * h1) / sum(exp(s1 - top1)) AS mean1, sum(exp(s2 - top2) * h2) / sum(exp(s2 - top2)) AS mean2,
         max(k1) * mean1 + max(k2) * mean2 + max(kb) AS logit""",
    backward="""
    SELECT *, (share1 * k1 + d1 * v11 + d2 * v21 + e1 * g11 + e2 * g21) * (h1 > 0)::INTEGER AS dh1,
              (share2 * k2 + d1 * v12 + d2 * v22 + e1 * g12 + e2 * g22) * (h2 > 0)::INTEGER AS dh2 FROM (
      SELECT *, di1 * q1 * (1 - t1 * t1) AS d1, di2 * q2 * (1 - t2 * t2) AS d2,
             di1 * t1 * q1 * (1 - q1) AS e1, di2 * t2 * q2 * (1 - q2) AS e2 FROM (
        SELECT *, ds1 * u11 + ds2 * u21 AS di1, ds1 * u12 + ds2 * u22 AS di2 FROM (
          SELECT *, share1 * k1 * (h1 - mean1) AS ds1, share2 * k2 * (h2 - mean2) AS ds2 FROM (
            SELECT *, slope * exp(s1 - top1) / z1 AS share1, slope * exp(s2 - top2) / z2 AS share2 FROM joined))))""",
)


def _start(models: str, kind: Restated = PLAIN) -> str:
    values = [float(v) for v in kind.model.flat()]
    named = ", ".join(f"{v!r} AS {n}" for n, v in zip(kind.gradients, values))
    zeros = ", ".join(f"0.0::DOUBLE AS m_{n}, 0.0::DOUBLE AS s_{n}" for n in kind.gradients)
    return f"p1 AS MATERIALIZED (SELECT f, {named}, {zeros} FROM {models})"


def _states(e: int, loss: str, match: str, kind: Restated = PLAIN) -> str:
    """Forward pass and bag scores of step ``e``."""
    value, slope = LOSSES[loss]
    return f"""
f{e} AS MATERIALIZED (
  WITH hidden AS (
      SELECT *, {kind.hidden} FROM inst JOIN folded USING (bag_id) JOIN p{e} ON {match}){kind.forward}),
m{e} AS MATERIALIZED (SELECT f, bag_id, {kind.tops} FROM f{e} GROUP BY f, bag_id),
z{e} AS MATERIALIZED (SELECT f, bag_id, label, {kind.pooled} FROM f{e} JOIN m{e} USING (f, bag_id) GROUP BY f, bag_id, label),
b{e} AS MATERIALIZED (
  SELECT *, 1 / (1 + exp(-logit)) AS p, {value} AS loss, {slope} AS slope
  FROM (SELECT *, (2 * label - 1) * logit AS z FROM z{e}))"""


def _update(e: int, lr: float, decay: float, kind: Restated = PLAIN) -> str:
    """Gradient and optimiser step after step ``e``."""
    b1, b2 = ADAM_BETAS
    params = list(kind.gradients)
    sums = ", ".join(f"sum({g}) / n + {decay!r} * max({n}) AS g_{n}" for n, g in kind.gradients.items())
    first = {n: f"({b1} * m_{n} + {1 - b1!r} * g_{n})" for n in params}
    second = {n: f"({b2} * s_{n} + {1 - b2!r} * g_{n} * g_{n})" for n in params}
    moved = ", ".join(
        f"{n} - {lr!r} * ({first[n]} / {1 - b1**e!r}) / (sqrt({second[n]} / {1 - b2**e!r}) + {ADAM_EPS!r}) AS {n}" for n in params
    )
    kept = ", ".join(f"{first[n]} AS m_{n}, {second[n]} AS s_{n}" for n in params)
    return f"""
g{e} AS MATERIALIZED (
  WITH joined AS (
    SELECT f{e}.*, b{e}.* EXCLUDE (f, bag_id, label), n
    FROM f{e} JOIN b{e} USING (f, bag_id) JOIN (SELECT f, count(*) AS n FROM b{e} GROUP BY f) USING (f))
  SELECT f, {sums} FROM ({kind.backward}) GROUP BY f, n),
p{e + 1} AS MATERIALIZED (SELECT f, {moved}, {kept} FROM p{e} JOIN g{e} USING (f))"""


def _training(epochs: int, lr: float, loss: str, decay: float, kind: Restated = PLAIN, tables: str = EVENTS) -> str:
    """One step per epoch, over all bags."""
    parts = [tables, "folded AS (SELECT bag_id, label, -2 AS fold FROM bags)", _start("(SELECT -1 AS f)", kind)]
    for e in range(1, epochs + 1):
        parts.append(_states(e, loss, "f <> fold", kind))
        if e < epochs:
            parts.append(_update(e, lr, decay, kind))
    return f"WITH {', '.join([*parts, _scores({e: e for e in range(1, epochs + 1)})])}"


def _whole_job() -> str:
    """Features of the order lines, training steps over all bags, and the scores of the trained scorer."""
    kind = replace(PLAIN, model=fx.LINE_MODEL, gradients=_plain_gradients(len(SIGNATURE_FEATURES)), dims=len(SIGNATURE_FEATURES))
    named = ", ".join(f"{c} AS x{i + 1}" for i, c in enumerate(SIGNATURE_FEATURES))
    tables = f"""{SIGNED.removeprefix('WITH ')},
inst AS MATERIALIZED (SELECT sample_name AS bag_id, {named} FROM signed),
bags AS (
  SELECT bag_id, CAST(CASE WHEN s_acctbal < 5000 THEN 0 ELSE 1 END AS INTEGER) AS label
  FROM (SELECT DISTINCT bag_id FROM inst)
  LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 1000) ON bag_id = 'S' || s_suppkey || 'raw')"""
    parts = [tables, "folded AS (SELECT bag_id, label, -2 AS fold FROM bags)", _start("(SELECT -1 AS f)", kind)]
    epochs = TRAIN["epochs"]
    for e in range(1, epochs + 1):
        parts += [_states(e, "bce", "f <> fold", kind), _update(e, TRAIN["lr"], 0.0, kind)]
    parts += [_states(epochs + 1, "bce", "f <> fold", kind)]
    return f"""WITH {', '.join(parts)}
SELECT bag_id, label, round(p, {R}) AS p, CAST(logit >= 0 AS INTEGER) AS pred FROM b{epochs + 1}"""


def _cv_reports() -> str:
    """Confusion, AUC and ROC points of the held-out bags of every fold."""
    cells = ", ".join(f"count(*) FILTER (label = {y} AND (p >= 0.5) = ({q} = 1)) AS c{y}{q}" for y in (0, 1) for q in (0, 1))
    return f"""WITH held AS ({_cross_validation(digits=15)}), {_roc('held', 'fold,', name='curve')}
SELECT fold, c00, c01, c10, c11, round(auc, {R}) AS auc, n_points, round(area, {R}) AS area
FROM (SELECT fold, {cells} FROM held GROUP BY fold)
JOIN ({_auc('held', 'fold,')}) USING (fold)
JOIN (SELECT fold, count(*) AS n_points, sum(fpr + tpr) AS area FROM curve GROUP BY fold) USING (fold)"""


def _scores(epoch_of: dict[int, int]) -> str:
    """Bag scores of all steps, by the epoch each step belongs to."""
    scores = " UNION ALL ".join(
        f"SELECT 'run0' AS run_id, CAST(f AS INTEGER) AS fold, CAST({epoch} AS INTEGER) AS epoch, bag_id, label, p, loss FROM b{step}"
        for step, epoch in epoch_of.items()
    )
    return f"scores AS MATERIALIZED ({scores})"


def _stepwise(tables: str, batches: int, lr: float) -> str:
    """One epoch of ``batches`` steps over shares of the shuffled order."""
    share = f"ntile({batches}) OVER (ORDER BY md5('{SEED}|1|' || bag_id), bag_id)"
    parts = [tables, f"folded AS MATERIALIZED (SELECT bag_id, label, {share} AS batch FROM bags)", _start("(SELECT -1 AS f)")]
    for step in range(1, batches + 1):
        parts.append(_states(step, "bce", f"batch = {step}"))
        if step < batches:
            parts.append(_update(step, lr, 0.0))
    return f"WITH {', '.join([*parts, _scores(dict.fromkeys(range(1, batches + 1), 1))])}"


def _history_of(training: str) -> str:
    return f"""{training}
SELECT run_id, fold, epoch, round(loss, {R}) AS loss, round(auc, {R}) AS auc
FROM (SELECT run_id, fold, epoch, sum(loss) AS loss FROM scores GROUP BY ALL)
JOIN ({_auc('scores', 'run_id, fold, epoch,')}) USING (run_id, fold, epoch)"""


def _history(loss: str, decay: float = 0.0, kind: Restated = PLAIN) -> str:
    return _history_of(_training(TRAIN["epochs"], TRAIN["lr"], loss, decay, kind))


FOLDED = f"SELECT bag_id, label, CAST(ntile({FOLDS}) OVER (ORDER BY md5('{SEED}|' || bag_id), bag_id) - 1 AS INTEGER) AS fold"


def _cross_validation(epochs: int = 2, lr: float = 0.05, digits: int = R) -> str:
    parts = [EVENTS, f"folded AS MATERIALIZED ({FOLDED} FROM bags)"]
    parts.append(_start(f"(SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS f)"))
    for e in range(1, epochs + 1):
        parts += [_states(e, "bce", "f <> fold"), _update(e, lr, 0.0)]
    parts.append(_states(epochs + 1, "bce", "f = fold"))
    return f"WITH {', '.join(parts)} SELECT f AS fold, bag_id, label, round(p, {digits}) AS p FROM b{epochs + 1}"


# Order lines as fragments

FRAGMENTS = """
frag AS (
  SELECT 'S' || l_suppkey || 'raw' AS sample_name,
         concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS chromosome,
         CAST(DATE '1992-01-01' - DATE '1970-01-01' AS BIGINT) AS frag_start,
         CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS frag_end,
         CAST(floor(l_quantity / 10) * 10 AS INTEGER) || '-' || (CAST(floor(l_quantity / 10) * 10 AS INTEGER) + 9) AS length_bin,
         l_returnflag AS out5p, l_linestatus AS in5p, l_discount AS gc_content, l_tax AS gc_weight
  FROM lineitem)"""
#: The wide rows: what can be read of them, and which of seven kinds of damage a row has.
WIDE = """
wide AS (
  SELECT 'S' || l_suppkey || 'raw' AS sample_name, l_orderkey % 7 AS seventh, l_returnflag AS out5p, l_linestatus AS in5p,
         CAST(DATE '1992-01-01' - DATE '1970-01-01' AS BIGINT) AS frag_start,
         CASE WHEN l_orderkey % 7 > 1 THEN CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) END AS ends,
         CASE WHEN l_orderkey % 7 NOT IN (2, 3) THEN l_discount END AS gc, l_quantity AS further
  FROM lineitem)"""


def _signature(name: str, token: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT sample_name, motif, ln((n + 1) / (total + kinds)) AS llh, ln(n / total) AS plain
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY sample_name) AS DOUBLE) AS total,
               count(*) OVER (PARTITION BY sample_name) AS kinds
        FROM (SELECT sample_name, replace({token}, '-', '_') AS motif, count(*) AS n FROM frag GROUP BY ALL))
  WHERE n * kinds >= total)"""


SIGNED = f"""WITH {FRAGMENTS},
{_signature('sig_out', 'out5p')}, {_signature('sig_in', 'in5p')}, {_signature('sig_len', 'length_bin')},
signed AS (
  SELECT f.* REPLACE (replace(length_bin, '-', '_') AS length_bin),
         coalesce(o.llh, 0) AS llh_out, coalesce(o.plain, 0) AS plain_out,
         coalesce(i.llh, 0) AS llh_in, coalesce(i.plain, 0) AS plain_in,
         coalesce(l.llh, 0) AS llh_len, coalesce(l.plain, 0) AS plain_len
  FROM frag f
  LEFT JOIN sig_out o ON o.sample_name = f.sample_name AND o.motif = f.out5p
  LEFT JOIN sig_in i ON i.sample_name = f.sample_name AND i.motif = f.in5p
  LEFT JOIN sig_len l ON l.sample_name = f.sample_name AND l.motif = replace(f.length_bin, '-', '_'))"""
SIGNATURE_FEATURES = ["gc_content", "gc_weight", "llh_out", "plain_out", "llh_in", "plain_in", "llh_len", "plain_len"]


def _scaled(c: str, part: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY {part})", f"max({c}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {low} <> {high} THEN ({c} - {low}) / ({high} - {low}) ELSE {c} * 0.0 END AS {c}"


def _sums(source: str, columns: list[str]) -> str:
    sums = ", ".join(f"round(sum({c}), {R}) AS {c}" for c in columns)
    return f"SELECT sample_name AS bag_id, count(*) AS n, {sums} FROM {source} GROUP BY sample_name"


def oracles() -> dict[str, str]:
    scored = _scored()
    events = f"WITH {EVENTS}, {_event_forward()}"
    cells = """
WITH cells AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k,
         CASE event_type WHEN 'view' THEN '   ' WHEN 'error' THEN NULL WHEN 'signup' THEN 'n/a ' || value
              WHEN 'click' THEN '  ' || value || ' ' ELSE CAST(value AS VARCHAR) END AS cell
  FROM events)"""
    vector = fx.EMBEDDING_MODEL
    weights = [[float(w) for w in vector.embed_w[j]] for j in range(2)]
    units = [f"list_dot_product(x, {weights[j]!r}::DOUBLE[]) + ({float(vector.embed_b[j])!r})" for j in range(2)]
    lines = f"(SELECT l_suppkey, l_orderkey, l_linenumber, {', '.join(SCALED[:-1])}, 1.0::DOUBLE AS always_one FROM lineitem)"
    frequency = ["gc_content", "fragment_length", "out5p_freq", "in5p_freq"]
    return {
        "sample_id_extract": """
WITH named AS (
  SELECT doc_id, source, lang || doc_id || CASE WHEN n_chars % 2 = 0 THEN 'raw' ELSE '' END AS name FROM documents)
SELECT doc_id, regexp_extract('a_filtered_' || name || '_filtered_raw_v7', 'filtered_(.*?raw)', 1) AS sample_id,
       name AS sample_name, replace(name, 'raw', '') AS label_key
FROM named""",
        "normalise_bin": """
SELECT l_orderkey, l_linenumber,
       CAST(floor(l_quantity / 10) * 10 AS INTEGER) || '_' || (CAST(floor(l_quantity / 10) * 10 AS INTEGER) + 9) AS length_bin
FROM lineitem""",
        "clean_numeric": f"""{cells}
SELECT event_id, coalesce(TRY_CAST(nullif(trim(cell), '') AS DOUBLE), 0) AS cell,
       coalesce(TRY_CAST(nullif(trim(k), '') AS DOUBLE), 0) AS k FROM cells""",
        "malformed_cells": f"""{cells}
SELECT 'cell' AS "column", count(*) FILTER (trim(cell) <> '' AND TRY_CAST(trim(cell) AS DOUBLE) IS NULL) AS n_malformed FROM cells
UNION ALL
SELECT 'k', count(*) FILTER (trim(k) <> '' AND TRY_CAST(trim(k) AS DOUBLE) IS NULL) FROM cells""",
        "suffix_and_drop": """
SELECT p_partkey AS p_partkey_out, p_brand AS p_brand_out, p_type AS p_type_out, p_size AS p_size_out,
       p_retailprice AS p_retailprice_out FROM part""",
        "name_fragment_columns": f"""WITH {FRAGMENTS}
SELECT out5p, in5p, length_bin, count(*) AS n, max(frag_end) AS last_end FROM frag GROUP BY ALL""",
        "fragment_length": """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS fragment_length
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "assemble_features": """
SELECT user_id AS bag_id, event_id AS instance_id, value AS first,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS second, CAST(2 AS INTEGER) AS width FROM events""",
        "hash_sample": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE CAST('0x' || substr(md5('{SEED}|' || concat_ws('-', l_orderkey, l_linenumber, l_partkey)), 1, 8) AS BIGINT)
      / {float(16**8)!r} < {SAMPLE_FRACTION}""",
        "label_binarise_lookup": """
WITH named AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS k, CASE WHEN n_regionkey < 2 THEN 'Healthy' WHEN n_regionkey = 2 THEN 'healthy' END AS t,
         n_nationkey AS row_no FROM nation
  UNION ALL
  SELECT CAST(n_nationkey AS VARCHAR), 'Breast', n_nationkey + 1000 FROM nation WHERE n_regionkey = 1),
known AS (SELECT k, max_by(CASE WHEN t = 'Healthy' THEN 0 ELSE 1 END, row_no) AS label FROM named GROUP BY k)
SELECT s_suppkey AS bag_id, CAST(coalesce(label, 1) AS INTEGER) AS label,
       CASE WHEN label IS NULL THEN 'default' ELSE 'table' END AS label_source
FROM supplier LEFT JOIN known ON k = CASE WHEN s_acctbal > 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'unknown' END""",
        "join_signatures": f"""{SIGNED}
SELECT sample_name, chromosome, out5p, in5p, length_bin,
       {', '.join(f'round({c}, {R}) AS {c}' for c in SIGNATURE_FEATURES[2:])} FROM signed""",
        "duplicate_signatures": f"""WITH {FRAGMENTS}, {_signature('sig_out', 'out5p')}
SELECT sample_name, motif AS "Motif", CAST(2 AS BIGINT) AS n FROM sig_out""",
        "frequency_encode": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, l_linestatus,
       count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS l_returnflag_freq,
       count(*) OVER (PARTITION BY l_suppkey, l_linestatus) AS l_linestatus_freq
FROM lineitem""",
        "feature_ranges": f"""
SELECT l_suppkey, {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in SCALED)} FROM {lines} GROUP BY l_suppkey""",
        "minmax_scale": f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {', '.join(f'round({c}, {R}) AS {c}' for c in SCALED)}
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, {', '.join(_scaled(c, 'l_suppkey') for c in SCALED)} FROM {lines})""",
        "bag_sizes": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey",
        "empty_bags": """
SELECT o_orderkey AS bag_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
        "union_bags": """
SELECT event_id, value, CASE WHEN event_type <> 'purchase' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
FROM events""",
        "assemble_bags": f"""WITH {EVENTS}
SELECT bag_id, label, count(*) AS n, count(*) AS n_in_blocks, round(sum(x1), {R}) AS sum_first, round(sum(x2), {R}) AS sum_second
FROM inst JOIN bags USING (bag_id) GROUP BY bag_id, label""",
        "embed_instances": f"{events} SELECT bag_id, instance_id, round(h1, {R}) AS h1, round(h2, {R}) AS h2 FROM emb",
        "attention_logits": f"{events} SELECT bag_id, instance_id, round(s, {R}) AS logit FROM lg",
        "attention_weights": f"""{events}
SELECT bag_id, instance_id, round(e / mass, {R}) AS attention FROM ex JOIN (SELECT bag_id, mass FROM pool) USING (bag_id)""",
        "attention_pool": f"""{events}
SELECT bag_id, round(top, {R}) AS top, round(mass, {R}) AS mass, round(m1, {R}) AS m1, round(m2, {R}) AS m2 FROM pool""",
        "score_bags": f"{events} SELECT bag_id, round(p, {R}) AS p, pred FROM sc",
        "score_bags_vector": f"""
WITH inst AS (SELECT 'group-' || label AS bag_id, vec_id AS instance_id, embedding::DOUBLE[] AS x FROM embeddings),
{_forward(vector, units)}
SELECT bag_id, round(logit, {R}) AS logit, round(p, {R}) AS p, pred FROM sc""",
        "gated_attention_pool": f"{_gated()} SELECT bag_id, round(m1, {R}) AS m1, round(m2, {R}) AS m2 FROM pool",
        "gated_attention_weights": f"""{_gated()}
SELECT bag_id, instance_id, round(e1 / z1, {R}) AS a1, round(e2 / z2, {R}) AS a2
FROM ex JOIN (SELECT bag_id, z1, z2 FROM pool) USING (bag_id)""",
        "score_bags_gated": f"""{_gated()}
SELECT bag_id, round(1 / (1 + exp(-logit)), {R}) AS p, CAST(logit >= 0 AS INTEGER) AS pred
FROM (SELECT *, {_affine(fx.EVENT_GATED_MODEL.cls_w, fx.EVENT_GATED_MODEL.cls_b[0], ['m1', 'm2'])} AS logit FROM pool)""",
        "bag_nll": f"""{scored}
SELECT bag_id, label, round(-ln(CASE WHEN label = 1 THEN q ELSE 1 - q END), {R}) AS nll
FROM (SELECT *, greatest(least(p, 1 - 1e-5), 1e-5) AS q FROM scored)""",
        "classification_error": f"{scored} SELECT round(1 - avg(CAST(pred = label AS INTEGER)), {R}) AS error FROM scored",
        "auc": f"{scored} SELECT round(auc, {R}) AS auc FROM ({_auc('scored')})",
        "roc_curve": f"{scored}, {_roc('scored')}",
        "confusion_matrix": f"""{scored}
SELECT CAST(y AS INTEGER) AS label, CAST(q AS INTEGER) AS pred, count(scored.bag_id) AS n
FROM (SELECT unnest([0, 0, 1, 1]) AS y, unnest([0, 1, 0, 1]) AS q) LEFT JOIN scored ON label = y AND pred = q
GROUP BY y, q""",
        "confusion_matrix_norm": f"""{scored}
SELECT CAST(y AS INTEGER) AS label, CAST(q AS INTEGER) AS pred,
       round(count(scored.bag_id) / sum(count(scored.bag_id)) OVER (PARTITION BY y), {R}) AS share
FROM (SELECT unnest([0, 0, 1, 1]) AS y, unnest([0, 1, 0, 1]) AS q) LEFT JOIN scored ON label = y AND pred = q
GROUP BY y, q""",
        "evaluate": f"""{scored}
SELECT count(*) FILTER (label = 0 AND pred = 0) AS c00, count(*) FILTER (label = 0 AND pred = 1) AS c01,
       count(*) FILTER (label = 1 AND pred = 0) AS c10, count(*) FILTER (label = 1 AND pred = 1) AS c11,
       (SELECT round(auc, {R}) FROM ({_auc('scored')})) AS auc FROM scored""",
        "bag_attention_series": f"""{events}
SELECT row_number() OVER (ORDER BY instance_id) - 1 AS position, instance_id, round(e / mass, {R}) AS attention
FROM ex JOIN (SELECT bag_id, mass FROM pool) USING (bag_id) WHERE bag_id = {CHOSEN_BAG}""",
        "attention_histogram": f"""{events},
att AS (SELECT label, e / mass AS x FROM ex JOIN (SELECT bag_id, mass FROM pool) USING (bag_id) JOIN bags USING (bag_id)),
rng AS (SELECT label, min(x) AS lo, max(x) AS hi FROM att GROUP BY label),
hit AS (SELECT label, CAST(least(floor(50 * (x - lo) / (hi - lo)) + 1, 50) AS INTEGER) AS bin, count(*) AS n
        FROM att JOIN rng USING (label) GROUP BY ALL),
slots AS (SELECT label, lo, (hi - lo) / 50 AS step, CAST(unnest(range(1, 51)) AS INTEGER) AS bin FROM rng)
SELECT label, bin, round(lo + step * (bin - 1), {R}) AS lo_edge, round(lo + step * bin, {R}) AS hi_edge,
       round(CASE WHEN lo + step * (bin - 1) > 0 THEN log10(lo + step * (bin - 1)) END, {R}) AS log10_lo_edge,
       coalesce(n, 0) AS n
FROM slots LEFT JOIN hit USING (label, bin)""",
        "shuffled_order": f"""WITH {EVENTS}
SELECT bag_id, row_number() OVER (ORDER BY md5('{SEED}|1|' || bag_id), bag_id) AS rank FROM bags""",
        "kfold_assign": f"WITH {EVENTS} SELECT bag_id, fold FROM ({FOLDED} FROM bags)",
        "cv_summary": f"""{scored}, folded AS ({FOLDED}, p FROM scored), per_fold AS ({_auc('folded', 'fold,')})
SELECT round(avg(auc), {R}) AS mean_auc, round(stddev_pop(auc), {R}) AS std_auc,
       count(auc) AS n_valid_folds, count(*) AS n_folds FROM per_fold""",
        "train_attention_bce": _history("bce"),
        "train_attention_focal": _history("focal", 1e-5),
        "train_attention_gated": _history("bce", kind=GATED),
        "train_attention_minibatch": _history_of(_stepwise(EVENTS, BATCHES, TRAIN["lr"])),
        "train_attention_stepwise": f"""{_stepwise(NATIONS, 25, TRAIN['lr'])}
SELECT epoch, bag_id, label, round(p, {R}) AS p, round(loss, {R}) AS loss FROM scores""",
        "train_roc": f"{_training(TRAIN['epochs'], TRAIN['lr'], 'bce', 0.0)}, {_roc('scores', 'run_id, fold,')}",
        "cross_validation": _cross_validation(),
        "cv_reports": _cv_reports(),
        "whole_job": _whole_job(),
        "exact_sample": f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('{SEED}|' || key)) AS nth,
             floor(count(*) OVER (PARTITION BY l_suppkey) * {SAMPLE_FRACTION} + 0.5) AS share
      FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS key FROM lineitem))
WHERE nth <= share""",
        "bernoulli_sample": """
SELECT count(*) AS n_rows, 0::BIGINT AS n_strange, true AS near_share, true AS repeats FROM lineitem""",
        "bag_store": f"""WITH {EVENTS}
SELECT bag_id, instance_id, label,
       CASE WHEN CAST('0x' || substr(md5('{SEED}|' || bag_id), 1, 8) AS BIGINT) / {float(16**8)!r} < 0.7
            THEN 'train' ELSE 'test' END AS split, x1 AS first, x2 AS second
FROM inst JOIN bags USING (bag_id)""",
        "model_store": f"{events} SELECT bag_id, round(p, {R}) AS p, pred FROM sc",
        "fragment_scan": f"""WITH {FRAGMENTS}
SELECT * REPLACE (CAST(gc_content AS VARCHAR) AS gc_content, CAST(gc_weight AS VARCHAR) AS gc_weight) FROM frag""",
        "label_scan": """
SELECT 'S' || s.k || 'raw' AS bag_id, 'train' AS split, CAST(CASE WHEN s_acctbal < 5000 THEN 0 ELSE 1 END AS INTEGER) AS label,
       CASE WHEN s_suppkey IS NULL THEN 'default' ELSE 'table' END AS label_source
FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) s
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 1000) ON s_suppkey = s.k""",
        "signature_path": f"{SIGNED} {_sums('signed', SIGNATURE_FEATURES)}",
        "signature_path_scaled": f"""{SIGNED},
scaled AS (SELECT sample_name, {', '.join(_scaled(c, 'sample_name') for c in SIGNATURE_FEATURES)} FROM signed)
{_sums('scaled', SIGNATURE_FEATURES)}""",
        "frequency_path": f"""WITH {FRAGMENTS},
enc AS (SELECT sample_name, gc_content, CAST(frag_end - frag_start AS DOUBLE) AS fragment_length,
               count(*) OVER (PARTITION BY sample_name, out5p) AS out5p_freq,
               count(*) OVER (PARTITION BY sample_name, in5p) AS in5p_freq FROM frag),
scaled AS (SELECT sample_name, gc_content, {', '.join(_scaled(c, 'sample_name') for c in frequency[1:])} FROM enc)
{_sums('scaled', frequency)}""",
        "frequency_path_wide": f"""WITH {FRAGMENTS}, {WIDE},
enc AS (SELECT sample_name, coalesce(gc, 0) AS gc_content, further AS c10, CAST(ends - frag_start AS DOUBLE) AS fragment_length,
               count(*) OVER (PARTITION BY sample_name, out5p) AS out5p_freq,
               count(*) OVER (PARTITION BY sample_name, in5p) AS in5p_freq FROM wide),
scaled AS (SELECT sample_name, gc_content, c10, {', '.join(_scaled(c, 'sample_name') for c in frequency[1:])} FROM enc),
filled AS (SELECT * REPLACE (coalesce(fragment_length, 0) AS fragment_length) FROM scaled)
{_sums('filled', ['gc_content', 'c10', *frequency[1:]])}""",
        "fragment_ids": f"""WITH {FRAGMENTS}
SELECT sample_name, length_bin, out5p, in5p, count(*) AS n, count(*) AS n_ids FROM frag GROUP BY ALL""",
        "cell_faults": f"""WITH {FRAGMENTS}, {WIDE},
f AS (SELECT sample_name, count(*) FILTER (seventh = 0) AS ends, count(*) FILTER (seventh = 2) AS nan,
             count(*) FILTER (seventh = 4) AS infinite, count(*) FILTER (seventh = 5) AS x FROM wide GROUP BY sample_name)
SELECT sample_name, 'frag_end' AS "column", ends AS n_malformed, 0::BIGINT AS n_nan, 0::BIGINT AS n_infinite FROM f WHERE ends > 0
UNION ALL SELECT sample_name, 'gc_content', 0, nan, 0 FROM f WHERE nan > 0
UNION ALL SELECT sample_name, 'gc_weight', x, 0, infinite FROM f WHERE x + infinite > 0""",
    }
