"""The same queries in SQL, over the star schema's tables."""

from __future__ import annotations

from .draws import HALF, PRIME, THRESHOLDS
from .queries import SEED, Z

VIEWS = {
    "v_ratings": "SELECT user_id item_id, concat('h', CAST(event_id % 5 AS varchar)) rater_id, max_by(event_type, event_id) rating, max_by(1 + CAST(floor(value) AS int) % 5, event_id) rating_num FROM events GROUP BY 1, 2",
    "v_sparse": "SELECT * FROM v_ratings WHERE rating <> 'view'",
    "v_lb": "SELECT event_id pair_id, event_id seq, item_id, model_a, model_b, CASE WHEN abs(va - vb) < 1 THEN 'tie' WHEN va > vb THEN model_a ELSE model_b END winner FROM (SELECT event_id, user_id item_id, event_type model_a, value va, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) model_b, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) vb FROM events) x WHERE model_b IS NOT NULL AND model_a <> model_b",
    "v_pos_random": "SELECT pair_id, seq, model_a option_a, model_b option_b, nullif(winner, 'tie') winner FROM v_lb",
    "v_pos_both": "SELECT item_id pair_id, seq, model_a option_a, model_b option_b, nullif(winner, 'tie') winner FROM v_lb",
    "v_paired": "SELECT l_orderkey item_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) a, max(CASE WHEN l_discount >= 0.07 THEN 1 ELSE 0 END) b, max(l_tax) a_cont, max(l_discount) b_cont FROM lineitem GROUP BY 1",
    "v_indep": "SELECT o_orderpriority grp, o_orderkey item_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END score, o_totalprice::DOUBLE score_cont FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "v_judge": "SELECT l.doc_id item_id, l.quality human, CASE WHEN d.n_chars >= 200 THEN 1 ELSE 0 END judge, d.lang slice FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "v_base": "SELECT item_id, item_id % 25 cluster_id, rater_id, rating FROM v_ratings",
    "v_base_judge": "SELECT user_id item_id, min_by(event_type, event_id) judge FROM events GROUP BY 1",
    "v_len": "SELECT a.doc_id pair_id, CASE WHEN x.quality >= y.quality THEN 1 ELSE 0 END preference, a.n_chars len_a, b.n_chars len_b, CASE WHEN x.toxic <= y.toxic THEN 1 ELSE 0 END human_preference FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 JOIN labels x ON x.doc_id = a.doc_id JOIN labels y ON y.doc_id = b.doc_id",
}
NEEDS = {"v_sparse": ["v_ratings"], "v_pos_random": ["v_lb"], "v_pos_both": ["v_lb"], "v_base": ["v_ratings"]}


def _with(views: str, body: str, *more: str) -> str:
    """body after the views it names, those they need, and further named steps."""
    names: list[str] = []
    for name in views.split():
        names += [n for n in (*NEEDS.get(name, []), name) if n not in names]
    return "WITH " + ",\n".join([*(f"{n} AS ({VIEWS[n]})" for n in names), *more]) + "\n" + body


def _r(x: str, places: int = 6) -> str:
    return f"round(({x})::DOUBLE, {places}) + 0.0"


def _values(units: str, key: str, n_boot: int, seed: int, name: str) -> list[str]:
    """Steps to `name` (b, k, t): the number under PRIME that each key of the step `units` has in each resample."""
    word = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    coefficients = ", ".join(word(f"concat_ws(':', '{seed}', b::VARCHAR, '{k}')") + f" % {PRIME} a{k}" for k in range(5))
    whole = "k" if key == "k" else "length(k::VARCHAR) || ':' || k::VARCHAR"  # a key named k is a text of lengths and parts already
    return [
        f"{name}_p AS (SELECT b, {coefficients} FROM unnest(range({n_boot})) x(b))",
        f"{name}_u AS (SELECT k, {word(whole)} v FROM (SELECT DISTINCT {key} k FROM {units}) x)",
        f"{name} AS (SELECT b, k, (((a3 * u + a2) % {PRIME} * u + a1) % {PRIME} * u + a0) % {PRIME} t FROM (SELECT *, ((v >> {HALF}) + a4 * (v & {(1 << HALF) - 1})) % {PRIME} u FROM {name}_u, {name}_p) y)",
    ]


def _keyed(units: str, key: str, n_boot: int, seed: int = SEED, name: str = "wt") -> list[str]:
    """Steps to `name` (b, k, w): the multiplicity of each key of the step `units` in each resample."""
    many = " ".join(f"WHEN t < {most} THEN {k}" for k, most in enumerate(THRESHOLDS))
    return [*_values(units, key, n_boot, seed, f"{name}_t"), f"{name} AS (SELECT b, k, CASE {many} ELSE {len(THRESHOLDS)} END w FROM {name}_t)"]


def _ends(column: str, n_boot: int, places: int = 6) -> tuple[str, str]:
    """A percentile interval, if nine tenths of the resamples have a number."""
    return tuple(f"CASE WHEN count({column}) >= 0.9 * {n_boot} THEN {_r(f'quantile_cont({column}, {q})', places)} END" for q in (0.025, 0.975))


def _boot_p(column: str) -> str:
    return _r(f"least(greatest(2 * least(avg(({column} <= 0)::INT), avg(({column} >= 0)::INT)), 1 / count({column})), 1)")


def _simpson(f: str, to: str, parts: int = 600) -> str:
    """The integral of f, of x, from 0."""
    return f"(SELECT sum(CASE WHEN i = 0 OR i = {parts} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f.replace('x', f'(i * ({to}) / {parts})')})) * ({to}) / {3 * parts} FROM unnest(range({parts + 1})) y(i))"


def _normal_two(z: str) -> str:
    """Both tails of the normal distribution beyond z."""
    return f"greatest(1 - sqrt(2 / pi()) * {_simpson('2.718281828459045 ** (-0.5 * x * x)', f'least(abs({z}), 9)')}, 0)"


def _normal(z: str) -> str:
    return f"CASE WHEN ({z}) > 0 THEN 1 - ({_normal_two(z)}) / 2 ELSE ({_normal_two(z)}) / 2 END"


def _t_quantile(df: str) -> str:
    """At 0.975, by the series about the normal quantile."""
    z = Z
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z} + {' + '.join(f'{t!r} / ({df}) ** {k}' for k, t in enumerate(terms, 1))})"


_T_DENSITY = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + x * x / df) ** (-(df + 1) / 2)".replace("exp", "2.718281828459045 ** ")


def _tail(low: str, high: str, at: str) -> str:
    """The binomial probability of low to below high of n."""
    return f"list_sum(list_transform(range({low}, {high}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({at}) + (n - i) * ln(1 - ({at})))))"


def _clopper_pearson(source: str, name: str) -> str:
    """Steps of a recursion to `name` at i = 50, (k, n, l, g): the 95 percent limits of k of n."""
    mid, up = "((l + lh) / 2)", "((g + gh) / 2)"
    under = f"k = 0 OR {_tail('k', 'n + 1', mid)} > 0.025"
    return f"""{name} AS (SELECT 0 i, k::BIGINT k, n::BIGINT n, 0.0::DOUBLE l, 1.0::DOUBLE lh, 0.0::DOUBLE g, 1.0::DOUBLE gh FROM {source} UNION ALL
  SELECT i + 1, k, n, CASE WHEN {under} THEN l ELSE {mid} END, CASE WHEN {under} THEN {mid} ELSE lh END,
         CASE WHEN k = n OR {_tail('0', 'k + 1', up)} > 0.025 THEN {up} ELSE g END, CASE WHEN k = n OR {_tail('0', 'k + 1', up)} > 0.025 THEN gh ELSE {up} END FROM {name} WHERE i < 50)"""


_CENTS = "d AS (SELECT round(a_cont::DOUBLE * 100) - round(b_cont::DOUBLE * 100) d FROM v_paired), z AS (SELECT d x, count(*) n FROM d WHERE d <> 0 GROUP BY 1)"
_WALSH = "w AS (SELECT (l.x + r.x) / 2 w, sum(CASE WHEN l.x = r.x THEN l.n * (l.n + 1) // 2 ELSE l.n * r.n END)::BIGINT n FROM z l JOIN z r ON l.x <= r.x GROUP BY 1)"


def _alpha(source: str, level: str, by: str = "") -> list[str]:
    """Steps to `alpha` over (item_id, rating) of the step `source`, by a column if there is one."""
    key, using = (f"{by}, ", f"USING ({by})") if by else ("", "")
    x = {"nominal": "0.0", "interval": "rating", "ordinal": "mid"}[level]
    spread = "m * m - c2" if level == "nominal" else "2 * (m * s2 - s1 * s1)"
    total = "n * n - g2" if level == "nominal" else "2 * (n * s2 - s1 * s1)"
    return [
        f"c0 AS (SELECT {key}item_id, rating, count(*) c FROM {source} GROUP BY ALL)",
        f"c1 AS (SELECT *, sum(c) OVER (PARTITION BY {key}item_id) m FROM c0 QUALIFY m >= 2)",
        f"g0 AS (SELECT {key}rating, sum(c)::DOUBLE g FROM c1 GROUP BY ALL)",
        f"g1 AS (SELECT *, sum(g) OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY rating) - g / 2 mid FROM g0)",
        f"units AS (SELECT {key}item_id, m::DOUBLE m, ({spread}) / (m - 1) o FROM (SELECT {key}item_id, sum(c)::DOUBLE m, sum(c * c)::DOUBLE c2, sum(c * {x}) s1, sum(c * {x} * {x}) s2 FROM c1 JOIN (SELECT {key}rating, mid FROM g1) q USING ({key}rating) GROUP BY ALL) y)",
        f"chance AS (SELECT {key}n, CASE WHEN n_values <= 1 THEN 0 ELSE {total} END e, n_values FROM (SELECT {key}sum(g) n, sum(g * g) g2, sum(g * {x}) s1, sum(g * {x} * {x}) s2, count(*) n_values FROM g1 GROUP BY ALL) y)",
        f"alpha AS (SELECT {key}CASE WHEN n_units >= 2 THEN 1 - (n - 1) * o / nullif(e, 0) END alpha, n_units, n::BIGINT n_ratings, n_values FROM (SELECT {key}sum(o) o, count(*) n_units FROM units GROUP BY ALL) y {f'JOIN chance {using}' if by else ', chance'})",
    ]


_ALPHA_OUT = f"SELECT {_r('alpha')} alpha, n_units, n_ratings, n_values FROM alpha"


def _dropout(source: str, level: str) -> str:
    whole = _alpha(source, level)
    without = []
    for step in _alpha("left_over", level, "out"):
        for name in ("c0", "c1", "g0", "g1", "units", "chance", "alpha"):
            step = step.replace(f"{name} AS (", f"o_{name} AS (", 1) if step.startswith(f"{name} AS (") else step
            step = step.replace(f"FROM {name} ", f"FROM o_{name} ").replace(f"FROM {name})", f"FROM o_{name})").replace(f"JOIN {name} ", f"JOIN o_{name} ")
        without.append(step)
    return _with("v_ratings", f"""SELECT r.out rater_id, r.n_ratings, {_r("CASE WHEN note = '' THEN w END")} alpha_without, {_r("CASE WHEN note = '' THEN w - alpha.alpha END")} delta, note
FROM (SELECT v.out, v.n_ratings, a.alpha w, CASE WHEN nr = 2 THEN 'only one rater left, nothing to compare' WHEN coalesce(a.n_units, 0) = 0 THEN 'no item left with two or more ratings'
  WHEN a.n_values <= 1 THEN 'remaining raters agreed everywhere, so alpha has no denominator' WHEN a.n_units < 2 THEN 'only one item left with two or more ratings' ELSE '' END note
  FROM votes v LEFT JOIN o_alpha a USING (out), (SELECT count(*) nr FROM votes) n WHERE nr >= 2) r, alpha""", f"src AS (SELECT item_id, rater_id, {'rating' if level == 'nominal' else 'rating_num::DOUBLE rating'} FROM v_ratings)", "votes AS (SELECT rater_id AS out, count(*) n_ratings FROM src GROUP BY 1)", "left_over AS (SELECT votes.out, src.* FROM src JOIN votes ON rater_id <> votes.out)", *whole, *without)


_BASE = [
    "kept AS (SELECT item_id, cluster_id, judge FROM (SELECT item_id, any_value(cluster_id) cluster_id, count(rating) n FROM v_base GROUP BY 1) x JOIN v_base_judge USING (item_id) WHERE n >= 2)",
    "c AS (SELECT item_id, cluster_id, judge, rating, count(*) c FROM v_base JOIN kept USING (item_id, cluster_id) GROUP BY ALL)",
    "obs AS (SELECT cluster_id, sum((m * m - c2) / (m - 1)) hh_o, sum(jo) jh_o FROM (SELECT item_id, cluster_id, sum(c)::DOUBLE m, sum(c * c) c2, sum(CASE WHEN rating <> judge THEN 2 * c ELSE 0 END)::DOUBLE jo FROM c GROUP BY ALL) x GROUP BY 1)",
    "marg AS (SELECT cluster_id, v, sum(hh)::DOUBLE hh, sum(jh)::DOUBLE jh FROM (SELECT cluster_id, rating v, c hh, c jh FROM c UNION ALL SELECT cluster_id, judge, 0, c FROM c) x GROUP BY 1, 2)",
]


def _two_alphas(o: str, m: str, by: str) -> str:
    key = f"{by}, " if by else ""
    return f"SELECT {key}1 - (jn - 1) * jh_o / nullif(jn * jn - j2, 0) judge_human, 1 - (hn - 1) * hh_o / nullif(hn * hn - h2, 0) human_human, judge_human - human_human difference FROM {o} {'JOIN' if by else ','} (SELECT {key}sum(hh) hn, sum(hh * hh) h2, sum(jh) jn, sum(jh * jh) j2 FROM {m} GROUP BY ALL) y {f'USING ({by})' if by else ''}"


_COUPLES = [
    "f AS (SELECT pair_id, option_a, option_b, min(seq) seq, min_by(winner, seq) winner FROM v_pos_both WHERE winner IS NOT NULL GROUP BY 1, 2, 3)",
    "met AS (SELECT x.pair_id, y.seq closed, x.winner = y.winner consistent, x.winner = x.option_a AND y.winner = y.option_a to_first FROM f x JOIN f y ON x.pair_id = y.pair_id AND x.option_a = y.option_b AND x.option_b = y.option_a AND x.seq < y.seq)",
    "couples AS (SELECT pair_id, min_by(consistent, closed) consistent, min_by(to_first, closed) to_first FROM met GROUP BY 1)",
]
_BINOMIAL = "least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM unnest(range(least(k, n - k) + 1)) u(i)))"
_LEN = "p AS (SELECT preference y1, (len_a - len_b)::DOUBLE x1, (preference <> human_preference)::INT y2, CASE WHEN human_preference = 1 THEN len_b - len_a ELSE len_a - len_b END::DOUBLE x2 FROM v_len)"
_CREDIT = "credit AS (SELECT i, j, sum(c) credit FROM (SELECT model_a i, model_b j, CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = model_a THEN 1 ELSE 0 END c FROM v_lb UNION ALL SELECT model_b, model_a, CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = model_b THEN 1 ELSE 0 END FROM v_lb) x GROUP BY 1, 2)"


def _outcomes(k: int, name: str) -> str:
    y, x = f"y{k}", f"x{k}"
    return f"SELECT '{name}' fit, count(*) n, count(*) FILTER ({y} = 1) n_ones, {_r(f'stddev_samp({x})')} sd, min(CASE WHEN {y} = 0 THEN {x} END) low0, max(CASE WHEN {y} = 0 THEN {x} END) high0, min(CASE WHEN {y} = 1 THEN {x} END) low1, max(CASE WHEN {y} = 1 THEN {x} END) high1 FROM p"


_DESIGNS = "designs AS (SELECT floor(item_id / 400)::BIGINT batch, count(*) n, avg(q.a::DOUBLE) base, avg((q.a <> q.b)::INT) r FROM v_paired q GROUP BY 1)"
_W = f"{Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n))"
_ZA, _ZB = 1.9599639845400536, 0.8416212335729144

def _paired_statistic(d: str) -> str:
    """Tango's, of a difference, over columns b, c and n."""
    linear = f"((2 * n - b + c) * {d} - b - c)"
    rate = f"(sqrt(greatest({linear} * {linear} + 8 * n * c * {d} * (1 - {d}), 0)) - {linear}) / (4 * n)"
    return f"(b - c - n * {d}) / sqrt(n * (2 * ({rate}) + {d} * (1 - {d})))"


_TANGO = f"""WITH RECURSIVE v_paired AS ({VIEWS["v_paired"]}),
s AS (SELECT count(*)::DOUBLE n, count(*) FILTER (a = 1 AND b = 0)::DOUBLE b, count(*) FILTER (a = 0 AND b = 1)::DOUBLE c FROM v_paired),
it AS (SELECT 0 i, n, b, c, -1 + 1e-9 l1, (b - c) / n h1, (b - c) / n l2, 1 - 1e-9 h2, NULL::DOUBLE m1, NULL::DOUBLE m2 FROM s
  UNION ALL
  SELECT i + 1, n, b, c, CASE WHEN {_paired_statistic("x1")} > {_ZA} THEN x1 ELSE l1 END, CASE WHEN {_paired_statistic("x1")} > {_ZA} THEN h1 ELSE x1 END,
         CASE WHEN {_paired_statistic("x2")} > -{_ZA} THEN x2 ELSE l2 END, CASE WHEN {_paired_statistic("x2")} > -{_ZA} THEN h2 ELSE x2 END, x1, x2
  FROM (SELECT *, (l1 + h1) / 2 x1, (l2 + h2) / 2 x2 FROM it WHERE i < 60) q)
SELECT {_r("(b - c) / n")} difference, {_r("m1")} ci_low, {_r("m2")} ci_high FROM it WHERE i = 60"""


def _independent_steps(d: str, name: str) -> str:
    """Mee's statistic as a lateral step `name`.t, from rates p1 and p2 of n1 and n2 and the difference d."""
    return f"""LATERAL (SELECT ({d}) d, 1 + n2 / n1 a) {name}0, LATERAL (SELECT -(a + p1 + n2 / n1 * p2 + d * (n2 / n1 + 2)) / a sq, (d * d + d * (2 * p1 + a) + p1 + n2 / n1 * p2) / a li, -p1 * d * (1 + d) / a co) {name}1,
  LATERAL (SELECT sq / 3 sh, (sq / 3) ** 3 - sq * li / 6 + co / 2 sk, sqrt(greatest((sq / 3) ** 2 - li / 3, 0)) sp) {name}2, LATERAL (SELECT CASE WHEN sk > 0 THEN sp ELSE -sp END u) {name}3,
  LATERAL (SELECT 2 * u * cos((pi() + acos(least(greatest(sk / u ** 3, -1), 1))) / 3) - sh r) {name}4, LATERAL (SELECT (p1 - p2 - {name}0.d) / sqrt(r * (1 - r) / n1 + (r - {name}0.d) * (1 - r + {name}0.d) / n2) t) {name}"""


def _bisected(goal: float, low: str, high: str, name: str) -> str:
    return f"""{name} AS (SELECT 0 i, {low} l, {high} h, n1, n2, p1, p2 FROM s UNION ALL
  SELECT i + 1, CASE WHEN z.t > {goal} THEN m ELSE l END, CASE WHEN z.t > {goal} THEN h ELSE m END, n1, n2, p1, p2 FROM (SELECT *, (l + h) / 2 m FROM {name} WHERE i < 60) q, {_independent_steps("m", "z")})"""


_MEE = f"""WITH RECURSIVE v_indep AS ({VIEWS["v_indep"]}),
s AS (SELECT count(*) FILTER (grp = '1-URGENT')::DOUBLE n1, count(*) FILTER (grp = '5-LOW')::DOUBLE n2, avg(CASE WHEN grp = '1-URGENT' THEN score END) p1, avg(CASE WHEN grp = '5-LOW' THEN score END) p2 FROM v_indep),
{_bisected(_ZA, "-1 + 1e-9", "p1 - p2", "low")},
{_bisected(-_ZA, "p1 - p2", "1 - 1e-9", "high")}
SELECT {_r("p1 - p2")} difference, {_r("(low.l + low.h) / 2")} ci_low, {_r("(SELECT (l + h) / 2 FROM high WHERE i = 60)")} ci_high FROM low WHERE i = 60"""

_REACH = "d - {z} * sqrt(2 * (b + d / 2) * (1 - b - d / 2) / (n / 2)) - {zb} * sqrt((b * (1 - b) + greatest((b + d) * (1 - b - d), 0)) / (n / 2))".format(z=_ZA, zb=_ZB)
_POWER_INDEP = _with("v_paired", f"""SELECT it.batch, it.n, {_r("it.b")} baseline, CASE WHEN f >= 0 THEN {_r("(l + h) / 2")} END difference FROM it JOIN top USING (batch) WHERE i = 80""", _DESIGNS,
    "g AS (SELECT batch, n, base b FROM designs)", f"it AS (SELECT 0 i, batch, n, b, 1e-12 l, 1 - b h FROM g UNION ALL SELECT i + 1, batch, n, b, CASE WHEN f < 0 THEN d ELSE l END, CASE WHEN f < 0 THEN h ELSE d END FROM (SELECT *, {_REACH} f FROM (SELECT *, (l + h) / 2 d FROM it WHERE i < 80) q) w)",
    f"top AS (SELECT batch, {_REACH} f FROM (SELECT *, 1 - b d FROM g) q)").replace("WITH ", "WITH RECURSIVE ", 1)

#: Ratings by repeated w / sum(n / (p + q)), which climbs to the same maximum.
_MM = f"""WITH RECURSIVE v_lb AS ({VIEWS["v_lb"]}), {_CREDIT},
models AS (SELECT list(DISTINCT i ORDER BY i) m FROM credit),
both_ways AS (SELECT x.i, x.j, x.credit + coalesce(y.credit, 0) n FROM credit x LEFT JOIN credit y ON x.i = y.j AND x.j = y.i),
n AS (SELECT list(row ORDER BY i) n FROM (SELECT i, list(coalesce(n, 0)::DOUBLE ORDER BY j) AS row FROM (SELECT a.i, b.i j FROM (SELECT DISTINCT i FROM credit) a, (SELECT DISTINCT i FROM credit) b) g LEFT JOIN both_ways USING (i, j) GROUP BY 1) x),
w AS (SELECT list(c ORDER BY i) w FROM (SELECT i, sum(credit)::DOUBLE c FROM credit GROUP BY 1) x),
it AS (SELECT 0 k, list_transform(w, lambda x: 1.0::DOUBLE) p FROM w UNION ALL
  SELECT k + 1, list_transform(range(1, len(p) + 1), lambda i: w[i] / list_sum(list_transform(range(1, len(p) + 1), lambda j: n[i][j] / (p[i] + p[j])))) FROM it, n, w WHERE k < 400),
t AS (SELECT m model, c total FROM (SELECT unnest(m) m FROM models) q JOIN (SELECT i m, sum(n) c FROM both_ways GROUP BY 1) z USING (m)),
r AS (SELECT unnest(m) model, unnest(list_transform(p, lambda x: ln(x))) s FROM it, models WHERE k = 400),
rated AS (SELECT model, s - (SELECT s FROM r JOIN t USING (model) ORDER BY total DESC, model LIMIT 1) rating, total FROM r JOIN t USING (model))
"""


def _newton(k: int, steps: int = 12) -> list[str]:
    """Steps to fit{k} (b0, b1, se) of y{k} on x{k} of p, from 0."""
    out = [f"b{k}_0 AS (SELECT 0.0::DOUBLE b0, 0.0::DOUBLE b1)"]
    for i in range(steps):
        sums = f"SELECT sum(w) w, sum(w * x) wx, sum(w * x * x) wxx, sum(r) r, sum(r * x) rx, any_value(b0) b0, any_value(b1) b1 FROM (SELECT x{k} x, q * (1 - q) w, y{k} - q r, b0, b1 FROM (SELECT *, 1 / (1 + exp(-b0 - b1 * x{k})) q FROM p, b{k}_{i}) e) f"
        out.append(f"b{k}_{i + 1} AS (SELECT b0 + (wxx * r - wx * rx) / (w * wxx - wx * wx) b0, b1 + (w * rx - wx * r) / (w * wxx - wx * wx) b1, sqrt(w / (w * wxx - wx * wx)) se FROM ({sums}) g)")
    return [*out, f"fit{k} AS (SELECT * FROM b{k}_{steps})"]


def _wilson_side(k: str, sign: str) -> str:
    p = f"({k} / n)"
    return f"(({p} + {Z * Z} / (2 * n) {sign} {Z} * sqrt({p} * (1 - {p}) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n))"


_PLAIN = f"""SELECT n::BIGINT n, b::BIGINT n_a_only, c::BIGINT n_b_only, (b + c)::BIGINT n_discordant, e::BIGINT n_both, {_r("d")} difference, {_r("greatest(d - wald, -1)")} wald_low, {_r("least(d + wald, 1)")} wald_high,
  {_r("greatest(d - sqrt((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2), -1)")} newcombe_low, {_r("least(d + sqrt((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2), 1)")} newcombe_high,
  {_r("greatest(d - sqrt((p1 - l1) ** 2 - 2 * phc * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2), -1)")} newcombe_corrected_low, {_r("least(d + sqrt((u1 - p1) ** 2 - 2 * phc * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2), 1)")} newcombe_corrected_high
FROM (SELECT *, (b - c) / n d, {Z} * sqrt(b + c - (b - c) ** 2 / n) / n wald, (e + b) / n p1, (e + c) / n p2, {_wilson_side("(e + b)", "-")} l1, {_wilson_side("(e + b)", "+")} u1, {_wilson_side("(e + c)", "-")} l2, {_wilson_side("(e + c)", "+")} u2,
  coalesce((e * (n - e - b - c) - b * c) / nullif(sqrt((e + b) * (e + c) * (n - e - b) * (n - e - c)), 0), 0) phi,
  coalesce((CASE WHEN e * (n - e - b - c) >= b * c THEN greatest(e * (n - e - b - c) - b * c - n / 2, 0) ELSE e * (n - e - b - c) - b * c END) / nullif(sqrt((e + b) * (e + c) * (n - e - b) * (n - e - c)), 0), 0) phc FROM (SELECT count(*)::DOUBLE n, count(*) FILTER (q.a = 1 AND q.b = 0)::DOUBLE b, count(*) FILTER (q.a = 0 AND q.b = 1)::DOUBLE c, count(*) FILTER (q.a = 1 AND q.b = 1)::DOUBLE e FROM v_paired q) x) y"""

_TANGO_BATCHES = (
    "per AS (SELECT floor(item_id / 400)::BIGINT batch, count(*)::DOUBLE n, count(*) FILTER (q.a = 1 AND q.b = 0)::DOUBLE b, count(*) FILTER (q.a = 0 AND q.b = 1)::DOUBLE c, count(*) FILTER (q.a = 1 AND q.b = 1)::DOUBLE e FROM v_paired q GROUP BY 1)",
    f"""it AS (SELECT 0 i, batch, n, b, c, -1 + 1e-9 l1, (b - c) / n h1, (b - c) / n l2, 1 - 1e-9 h2 FROM per WHERE b + c > 0
  UNION ALL
  SELECT i + 1, batch, n, b, c, CASE WHEN {_paired_statistic("x1")} > {_ZA} THEN x1 ELSE l1 END, CASE WHEN {_paired_statistic("x1")} > {_ZA} THEN h1 ELSE x1 END,
         CASE WHEN {_paired_statistic("x2")} > -{_ZA} THEN x2 ELSE l2 END, CASE WHEN {_paired_statistic("x2")} > -{_ZA} THEN h2 ELSE x2 END
  FROM (SELECT *, (l1 + h1) / 2 x1, (l2 + h2) / 2 x2 FROM it WHERE i < 60) q)""",
)
_COVERAGE_PAIRED = _with("v_paired", f"""SELECT count(*) n_batches, {", ".join(f"{_r(f'avg(({k}_low <= truth AND truth <= {k}_high)::INT)')} {k}" for k in ("wald", "newcombe", "newcombe_corrected", "score"))}
FROM (SELECT *, coalesce((l1 + h1) / 2, -({_ZA} ** 2) / (n + {_ZA} ** 2)) score_low, coalesce((l2 + h2) / 2, {_ZA} ** 2 / (n + {_ZA} ** 2)) score_high FROM ({_PLAIN.replace("SELECT n::BIGINT n,", "SELECT batch, n::BIGINT n,", 1).split("FROM (SELECT count(*)")[0]}FROM per) y) p LEFT JOIN (SELECT batch, l1, h1, l2, h2 FROM it WHERE i = 60) s USING (batch)) z,
  (SELECT avg(q.a - q.b) truth FROM v_paired q) t""", *_TANGO_BATCHES).replace("WITH ", "WITH RECURSIVE ", 1)

_URGENT = "t AS (SELECT item_id, score x, score_cont y FROM v_indep WHERE grp = '1-URGENT')"
_LOW = "l AS (SELECT item_id, score x, score_cont y FROM v_indep WHERE grp = '5-LOW')"
_SCORE_CI = _with("v_indep", f"""SELECT 'wilson' method, n, {_r('p', 4)} estimate, {_r(f'(p + {Z * Z} / (2 * n) - {_W}) / (1 + {Z * Z} / n)', 4)} ci_low, {_r(f'(p + {Z * Z} / (2 * n) + {_W}) / (1 + {Z * Z} / n)', 4)} ci_high, true AS binary FROM (SELECT count(*) n, avg(x) p FROM t) q
UNION ALL SELECT 'bootstrap', (SELECT count(*) FROM t), (SELECT {_r('avg(x)', 4)} FROM t), {', '.join(_ends('m', 10_000, 4))}, true FROM draws
UNION ALL SELECT 't', n, {_r('m', 4)}, {_r(f'm - {_t_quantile("n - 1")} * s / sqrt(n)', 4)}, {_r(f'm + {_t_quantile("n - 1")} * s / sqrt(n)', 4)}, false FROM (SELECT count(*) n, avg(y / 1000) m, stddev_samp(y / 1000) s FROM t) q""", _URGENT, *_keyed("t", "item_id", 10_000), "draws AS (SELECT b, sum(w * x) / nullif(sum(w), 0) m FROM wt JOIN t ON k = item_id GROUP BY 1)")

_RANKED = "rk AS (SELECT sum(t)::DOUBLE n, sum(mid * pos)::DOUBLE wp, sum(mid * (t - pos))::DOUBLE wn, sum(t * t * t - t)::DOUBLE ties FROM (SELECT t, pos, coalesce(sum(t) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 mid FROM (SELECT abs(x) s, sum(n)::BIGINT t, sum(CASE WHEN x > 0 THEN n ELSE 0 END) pos FROM z GROUP BY 1) q) y)"
_COMPARE_PAIRED = _TANGO.rsplit("\nSELECT", 1)[0] + f""",
{_CENTS}, {_WALSH}, {_RANKED}, c AS (SELECT w, sum(n) OVER (ORDER BY w) upto FROM w),
items AS (SELECT item_id, round(a_cont::DOUBLE * 100) - round(b_cont::DOUBLE * 100) x FROM v_paired),
{", ".join(_keyed("items", "item_id", 10_000))},
draws AS (SELECT b, sum(w * x) / nullif(sum(w), 0) m FROM wt JOIN items ON k = item_id GROUP BY 1)
SELECT 'mcnemar' method, n::BIGINT n, {_r("(b - c) / n")} difference, {_r("m1")} ci_low, {_r("m2")} ci_high, {_r(_normal_two("(abs(b - c) - 1) / sqrt(b + c)"))} p_value, true AS binary, true paired FROM it WHERE i = 60
UNION ALL SELECT 'bootstrap', (SELECT count(*) FROM items), (SELECT {_r("avg(x)")} FROM items), {", ".join(_ends("m", 10_000))}, {_boot_p("m")}, false, true FROM draws
UNION ALL SELECT 'wilcoxon', n::BIGINT, {_r("((SELECT min(w) FROM c WHERE upto > (total - 1) // 2) + (SELECT min(w) FROM c WHERE upto > total // 2)) / 2")}, {_r("(SELECT min(w) FROM c WHERE upto > cut)")}, {_r("(SELECT min(w) FROM c WHERE upto > total - 1 - cut)")}, {_r(_normal_two("(least(wp, wn) - n * (n + 1) / 4) / sd"))}, false, true
FROM (SELECT *, least(greatest(floor(n * (n + 1) / 4 - {_ZA} * sd), 0), (total - 1) // 2)::BIGINT cut FROM (SELECT *, (n * (n + 1) / 2)::BIGINT total, sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) sd FROM rk) q) y"""

_COMPARE_INDEPENDENT = _MEE.rsplit("\nSELECT", 1)[0] + f""",
{_URGENT}, {_LOW}, {", ".join(_keyed("t", "item_id", 10_000))}, {", ".join(_keyed("l", "item_id", 10_000, SEED + 1, "wl"))},
m1 AS (SELECT b, sum(w * x) / nullif(sum(w), 0) m FROM wt JOIN t ON k = item_id GROUP BY 1), m2 AS (SELECT b, sum(w * x) / nullif(sum(w), 0) m FROM wl JOIN l ON k = item_id GROUP BY 1),
draws AS (SELECT b, m1.m - m2.m m FROM m1 JOIN m2 USING (b)),
e AS (SELECT avg(y / 1e6) m, var_samp(y / 1e6) / count(*) e, count(*) n, 1 side FROM t UNION ALL SELECT avg(y / 1e6), var_samp(y / 1e6) / count(*), count(*), 2 FROM l)
SELECT 'score' method, (n1 + n2)::BIGINT n, {_r("p1 - p2")} difference, {_r("(low.l + low.h) / 2")} ci_low, {_r("(SELECT (l + h) / 2 FROM high WHERE i = 60)")} ci_high, {_r(_normal_two("(p1 - p2) / sqrt((p1 * n1 + p2 * n2) / (n1 + n2) * (1 - (p1 * n1 + p2 * n2) / (n1 + n2)) * (1 / n1 + 1 / n2))"))} p_value, true AS binary, false paired FROM low WHERE i = 60
UNION ALL SELECT 'bootstrap', (SELECT (n1 + n2)::BIGINT FROM s), (SELECT {_r("p1 - p2")} FROM s), {", ".join(_ends("m", 10_000))}, {_boot_p("m")}, true, false FROM draws
UNION ALL SELECT 't', n, {_r("d")}, {_r(f"d - {_t_quantile('df')} * se")}, {_r(f"d + {_t_quantile('df')} * se")}, {_r('1 - 2 * ' + _simpson(_T_DENSITY, 'least(abs(d / se), 40)'))}, false, false
FROM (SELECT (a.n + b.n)::BIGINT n, a.m - b.m d, sqrt(a.e + b.e) se, (a.e + b.e) ** 2 / (a.e ** 2 / (a.n - 1) + b.e ** 2 / (b.n - 1)) df FROM e a, e b WHERE a.side = 1 AND b.side = 2) q"""

_NULL = _with("v_paired", """SELECT sizes.n, n_batches, k AS sum, c patterns, coalesce((SELECT max(k) FROM u y WHERE y.n = u.n AND y.upto <= 0.025 * (1 << y.n)), 0) AS trim FROM u JOIN sizes ON sizes.n = u.n""",
    "sizes AS (SELECT n, count(*) n_batches FROM (SELECT floor(item_id / 12) batch, count(*) FILTER (round(a_cont::DOUBLE * 100) <> round(b_cont::DOUBLE * 100)) n FROM v_paired GROUP BY 1) q WHERE n > 0 GROUP BY 1)",
    "p AS (SELECT n, unnest(range((1 << n)::BIGINT)) m FROM sizes)", "s AS (SELECT n, m, sum(CASE WHEN (m >> (r - 1)) & 1 = 1 THEN r ELSE 0 END)::BIGINT k FROM p JOIN (SELECT unnest(range(1, 13)) r) y ON r <= n GROUP BY 1, 2)",
    "d AS (SELECT n, k, count(*) c FROM s GROUP BY 1, 2)", "u AS (SELECT *, sum(c) OVER (PARTITION BY n ORDER BY k) upto FROM d)")

_POWER = _with("v_paired", f"""SELECT batch, n, {_r("base")} baseline, {_r("r")} discordance_rate, {_r(f"CASE WHEN 0.05 <= r THEN {_normal(f'(sqrt(n) * 0.05 - {_ZA} * sqrt(r)) / sqrt(r - 0.0025)')} END")} paired_power,
  {_r(f"CASE WHEN base + 0.05 <= 1 THEN {_normal(f'(0.05 * sqrt(n / 2) - {_ZA} * sqrt(2 * (base + 0.025) * (0.975 - base))) / sqrt(base * (1 - base) + (base + 0.05) * (0.95 - base))')} END")} independent_power,
  CASE WHEN 0.05 <= r THEN ceil((({_ZA} * sqrt(r) + {_ZB} * sqrt(r - 0.0025)) / 0.05) ** 2)::BIGINT END n_paired FROM designs""", _DESIGNS)

_SPECIAL = _with("v_paired", f"""SELECT batch, n, k, {_r("z")} z, {_r(_normal_two("z"))} normal, {_r(_normal_two("z"))} chi2, {_r("1 - 2 * " + _simpson(_T_DENSITY, "least(abs(z), 40)"))} t, 0.05::DOUBLE back, low, high
FROM (SELECT batch, q.n, q.k, n - 1 df, z FROM q) w JOIN (SELECT k, n, {_r("CASE WHEN k = 0 THEN 0 ELSE (l + lh) / 2 END")} low, {_r("CASE WHEN k = n THEN 1 ELSE (g + gh) / 2 END")} high FROM cp WHERE i = 50) c USING (k, n)""",
    "q AS (SELECT floor(item_id / 400)::BIGINT batch, count(*) n, sum(y.a)::BIGINT k, (count(*) FILTER (y.a = 1 AND y.b = 0) - count(*) FILTER (y.a = 0 AND y.b = 1)) / sqrt(greatest(count(*) FILTER (y.a <> y.b), 1)) z FROM v_paired y GROUP BY 1 HAVING count(*) > 1)",
    "cp0 AS (SELECT DISTINCT k, n FROM q)", _clopper_pearson("cp0", "cp")).replace("WITH ", "WITH RECURSIVE ", 1)

def _alpha_boot(level: str, by: str = "") -> list[str]:
    """Steps after _alpha's to `draws` (by, b, a), weighing items by the step `wt`."""
    key, x = (f"{by}, ", {"nominal": "0.0", "interval": "rating", "ordinal": "mid"}[level]) if by else ("", {"nominal": "0.0", "interval": "rating", "ordinal": "mid"}[level])
    total, enough = ("n * n - g2", "n * n - g2 > 0") if level == "nominal" else ("2 * (n * s2 - s1 * s1)", "nv > 1")
    observed = f"SELECT {key}b, sum(w * o) o FROM wt JOIN units ON k = item_id GROUP BY ALL"
    if level == "ordinal":
        observed = "SELECT b, sum(w * 2 * (m * s2 - s1 * s1) / (m - 1)) o FROM (SELECT b, k, any_value(w) w, sum(c)::DOUBLE m, sum(c * mid) s1, sum(c * mid * mid) s2 FROM wt JOIN c1 ON k = item_id JOIN mids USING (b, rating) GROUP BY 1, 2) x GROUP BY 1"
    return [
        f"mids AS (SELECT *, sum(g) OVER (PARTITION BY {key}b ORDER BY rating) - g / 2 mid FROM (SELECT {key}b, rating, sum(w * c)::DOUBLE g FROM wt JOIN c1 ON k = item_id GROUP BY ALL) x)",
        f"eb AS (SELECT {key}b, sum(g) n, sum(g * g) g2, sum(g * {x}) s1, sum(g * {x} * {x}) s2, count(*) FILTER (g > 0) nv FROM mids GROUP BY ALL)",
        f"ob AS ({observed})",
        f"draws AS (SELECT {key}b, CASE WHEN {enough} THEN 1 - (n - 1) * o / ({total}) END a FROM eb JOIN ob USING ({key}b))",
    ]


def _agreement(level: str) -> str:
    source = "SELECT item_id, rating FROM v_ratings" if level == "nominal" else "SELECT item_id, rating_num::DOUBLE rating FROM v_ratings"
    steps = [f"src AS ({source})", *_alpha("src", level), *_keyed("units", "item_id", 1000), *_alpha_boot(level)]
    return "SELECT * FROM (" + _with("v_ratings", f"SELECT '{level}' AS level, {_r('any_value(alpha.alpha)')} alpha, {_ends('a', 1000)[0]} ci_low, {_ends('a', 1000)[1]} ci_high, (SELECT count(DISTINCT item_id) FROM v_ratings) n_items, (SELECT count(DISTINCT rater_id) FROM v_ratings) n_raters, any_value(n_units) n_overlapping_items, 1000::BIGINT n_boot, count(a) n_boot_usable, false one_value FROM draws, alpha", *steps) + f") {level}_rows"


_JUDGED = _with("v_judge", f"""SELECT slice, any_value(x.n_items) n_items, {_r('any_value(alpha)')} agreement, CASE WHEN any_value(note) = '' THEN {_ends('a', 1000)[0]} END ci_low, CASE WHEN any_value(note) = '' THEN {_ends('a', 1000)[1]} END ci_high, {_r('any_value(accuracy)')} accuracy, any_value(note) note
FROM (SELECT slice, count(*) n_items, avg((human = judge)::INT) accuracy FROM both_ways GROUP BY 1) x JOIN (SELECT *, CASE WHEN n_units < 2 THEN 'one item, too few to measure agreement' WHEN n_values <= 1 THEN 'human and judge used one label throughout, so alpha has no denominator' ELSE '' END note FROM alpha) y USING (slice) LEFT JOIN draws USING (slice) GROUP BY 1""",
    "both_ways AS (SELECT '(all)' slice, item_id, human, judge FROM v_judge UNION ALL SELECT slice, item_id, human, judge FROM v_judge)", "src AS (SELECT slice, item_id, human rating FROM both_ways UNION ALL SELECT slice, item_id, judge FROM both_ways)", *_alpha("src", "nominal", "slice"), *_keyed("v_judge", "item_id", 1000), *_alpha_boot("nominal", "slice"))
_JUDGE_BASELINE = _with("v_base v_base_judge", f"""SELECT n_items, n_dropped, {_r('accuracy')} accuracy, {_r('alpha')} agreement, {_r('judge_human')} baseline_judge_human, {_r('human_human')} baseline_human_human, {_r('difference')} baseline_difference, lo baseline_ci_low, hi baseline_ci_high,
  (SELECT count(*) FROM kept) baseline_n_items, (SELECT count(*) FROM obs) baseline_n_clusters, (SELECT count(*) FROM (SELECT item_id FROM v_base GROUP BY 1 HAVING count(rating) < 2) q) baseline_n_too_few_humans, usable baseline_n_boot_usable
FROM (SELECT count(human) n_items, count(*) - count(human) n_dropped, avg((human = judge)::INT) accuracy FROM told) a, alpha, point, (SELECT {_ends('difference', 1000)[0]} lo, {_ends('difference', 1000)[1]} hi, count(difference) usable FROM draws) z""",
    *_BASE, "told AS (SELECT item_id, judge, rating human FROM v_base_judge LEFT JOIN (SELECT item_id, rating FROM v_ratings WHERE rater_id = 'h0') h USING (item_id))", "src AS (SELECT item_id, human rating FROM told WHERE human IS NOT NULL UNION ALL SELECT item_id, judge FROM told WHERE human IS NOT NULL)", *_alpha("src", "nominal"),
    f"point AS ({_two_alphas('(SELECT sum(hh_o) hh_o, sum(jh_o) jh_o FROM obs) o', '(SELECT v, sum(hh) hh, sum(jh) jh FROM marg GROUP BY 1) m', '')})", *_keyed("obs", "cluster_id", 1000), "oo AS (SELECT b, sum(w * hh_o) hh_o, sum(w * jh_o) jh_o FROM wt JOIN obs ON k = cluster_id GROUP BY 1)", "mm AS (SELECT b, v, sum(w * hh) hh, sum(w * jh) jh FROM wt JOIN marg ON k = cluster_id GROUP BY 1, 2)", f"draws AS ({_two_alphas('oo', 'mm', 'b')})")
_POSITION = _with("v_pos_random v_pos_both", f"""SELECT 'randomised' design, {_r('cp.k / cp.n')} estimate, {_r('(l + lh) / 2')} ci_low, {_r('(g + gh) / 2')} ci_high, {_r('p')} p_value, s.k n_a_wins, s.n n_decisive, n_pairs, s.n n_pairs_scored, n_judgements, n_ties FROM cp, ps s WHERE i = 50
UNION ALL SELECT 'both_orders', {_r('k / n')}, {_r(_wilson_side('k', '-'))}, {_r(_wilson_side('k', '+'))}, {_r('p')}, first, flipped, (SELECT count(DISTINCT pair_id) FROM v_pos_both), n::BIGINT, (SELECT count(*) FROM v_pos_both), (SELECT count(*) - count(winner) FROM v_pos_both) FROM (SELECT scored::DOUBLE n, held::DOUBLE k, first, flipped, (SELECT {_BINOMIAL} FROM (SELECT flipped n, first k) q) p FROM cc) x""", *_COUPLES,
    f"ps AS (SELECT *, {_BINOMIAL} p FROM (SELECT count(*) FILTER (winner = option_a)::BIGINT k, count(winner)::BIGINT n, count(DISTINCT pair_id) n_pairs, count(*) n_judgements, count(*) - count(winner) n_ties FROM v_pos_random) x)", "cc AS (SELECT count(*)::BIGINT scored, count(*) FILTER (consistent)::BIGINT held, count(*) FILTER (NOT consistent)::BIGINT flipped, count(*) FILTER (NOT consistent AND to_first)::BIGINT AS first FROM couples)", _clopper_pearson("ps", "cp")).replace("WITH ", "WITH RECURSIVE ", 1)
_ITEM_CREDIT = "ic AS (SELECT item_id, i, j, sum(c) credit, 1 many FROM (SELECT item_id, model_a i, model_b j, CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = model_a THEN 1 ELSE 0 END::DOUBLE c FROM v_lb UNION ALL SELECT item_id, model_b, model_a, CASE WHEN winner = 'tie' THEN 0.5 WHEN winner = model_b THEN 1 ELSE 0 END::DOUBLE FROM v_lb) x GROUP BY ALL)"
_BOOT_CREDIT = "cb AS (SELECT b, i, j, sum(w * credit) credit FROM wt JOIN ic ON k = item_id GROUP BY ALL)"
def _boards(*own: str) -> str:
    """Ratings s of every resample and, at b = -1, of all comparisons, by the same climb as _MM. own: steps to ic (item_id, i, j, credit, many) and wt."""
    return "WITH RECURSIVE " + ",\n".join([
        f"v_lb AS ({VIEWS['v_lb']})", *own, _BOOT_CREDIT, "every AS (SELECT * FROM cb UNION ALL SELECT -1, i, j, sum(credit * many) FROM ic GROUP BY ALL)", "names AS (SELECT DISTINCT i m FROM ic)",
        "grid AS (SELECT b, x.m i, y.m j FROM (SELECT DISTINCT b FROM every) q, names x, names y)", "full_grid AS (SELECT g.b, g.i, g.j, coalesce(e.credit, 0) won, coalesce(f.credit, 0) lost FROM grid g LEFT JOIN every e ON e.b = g.b AND e.i = g.i AND e.j = g.j LEFT JOIN every f ON f.b = g.b AND f.i = g.j AND f.j = g.i)",
    ]) + """,
lines AS (SELECT b, i, list(won + lost ORDER BY j) met, sum(won) won FROM full_grid GROUP BY 1, 2),
mats AS (SELECT b, list(met ORDER BY i) n, list(won ORDER BY i) w, list(i ORDER BY i) m FROM lines GROUP BY 1),
it AS (SELECT 0 k, b, n, w, list_transform(w, lambda x: 1.0::DOUBLE) p FROM mats UNION ALL
  SELECT k + 1, b, n, w, list_transform(range(1, len(p) + 1), lambda i: w[i] / list_sum(list_transform(range(1, len(p) + 1), lambda j: n[i][j] / (p[i] + p[j])))) FROM it WHERE k < 120),
r0 AS (SELECT b, unnest(m) model, unnest(list_transform(p, lambda x: ln(x))) s FROM it JOIN mats USING (b) WHERE k = 120),
r AS (SELECT b, model, s - avg(s) OVER (PARTITION BY b) s FROM r0),
point AS (SELECT model, s, met FROM r JOIN (SELECT i model, sum(won + lost) met FROM full_grid WHERE b = -1 GROUP BY 1) q USING (model) WHERE b = -1)
"""  # fmt: skip


def _by_class(n_boot: int, seed: int = SEED) -> list[str]:
    """Steps of _boards for single comparisons: equal ones are one unit, drawn as often as that many would be."""
    part = lambda c: f"coalesce(length({c}) || ':' || {c}, 'n')"
    once = " ".join(f"WHEN t < {most} THEN {k}" for k, most in enumerate(THRESHOLDS))
    return [
        f"cls AS (SELECT *, {part('model_a')} || {part('model_b')} || {part('w')} k FROM (SELECT model_a, model_b, nullif(winner, 'tie') w, count(*) many FROM v_lb GROUP BY ALL) x)",
        "ic AS (SELECT k item_id, model_a i, model_b j, CASE WHEN w IS NULL THEN 0.5 WHEN w = model_a THEN 1 ELSE 0 END::DOUBLE credit, many FROM cls UNION ALL SELECT k, model_b, model_a, CASE WHEN w IS NULL THEN 0.5 WHEN w = model_b THEN 1 ELSE 0 END::DOUBLE, many FROM cls)",
        *_values("cls", "k", n_boot, seed, "ct"),
        "pk AS (SELECT many, greatest(0, many - 15 * floor(sqrt(many))::BIGINT - 40) low, many + 15 * floor(sqrt(many))::BIGINT + 39 high FROM (SELECT DISTINCT many FROM cls WHERE many > 1) x)",
        "pm AS (SELECT many, low, list(upto ORDER BY k) l FROM (SELECT many, low, k, sum(exp(k * ln(many) - many - lgamma(k + 1))) OVER (PARTITION BY many ORDER BY k) upto FROM (SELECT *, unnest(range(low, high + 1)) k FROM pk) x) y GROUP BY 1, 2)",
        f"wt AS (SELECT b, ct.k, CASE WHEN many > 1 THEN low + len(list_filter(l, lambda x: x <= (t + 0.5) / {PRIME})) {once} ELSE {len(THRESHOLDS)} END w FROM ct JOIN cls USING (k) LEFT JOIN pm USING (many))",
    ]


_BOARDS = _boards(_ITEM_CREDIT, *_keyed("v_lb", "item_id", 1000))
_WIDTHS = ", gaps AS (SELECT quantile_cont(u.s - v.s, 0.975) - quantile_cont(u.s - v.s, 0.025) width FROM r u JOIN r v USING (b) WHERE u.b >= 0 AND u.model < v.model GROUP BY u.model, v.model) SELECT count(*) n, avg(width) w FROM gaps"
_DESIGN_EFFECT = f"SELECT x.n n_pairs, {_r('x.w / y.w')} width_ratio, {_r('(x.w / y.w) ** 2')} design_effect FROM ({_BOARDS}{_WIDTHS}) x, ({_boards(*_by_class(1000))}{_WIDTHS}) y"
_BT_PAIRS = _BOARDS + f"""SELECT a model_a, c model_b, {_r("d", 4)} difference, {_r("lo", 4)} ci_low, {_r("hi", 4)} ci_high, {_r("1 / (1 + exp(-d))", 4)} p_a_beats_b, round(n)::BIGINT n_head_to_head, lo > 0 OR hi < 0 separable
FROM (SELECT x.model a, y.model c, x.s - y.s d, (SELECT won + lost FROM full_grid WHERE b = -1 AND i = x.model AND j = y.model) n FROM point x JOIN point y ON x.s > y.s) q
JOIN (SELECT u.model a, v.model c, quantile_cont(u.s - v.s, 0.025) lo, quantile_cont(u.s - v.s, 0.975) hi FROM r u JOIN r v USING (b) WHERE u.b >= 0 AND u.model <> v.model GROUP BY 1, 2) z USING (a, c)"""
_BT_INTERVALS = _BOARDS + f"""SELECT model, {_r("point.s - f.s", 4)} rating, {_r("lo - f.s", 4)} ci_low, {_r("hi - f.s", 4)} ci_high FROM point JOIN (SELECT model, quantile_cont(s, 0.025) lo, quantile_cont(s, 0.975) hi FROM r WHERE b >= 0 GROUP BY 1) q USING (model), (SELECT s FROM point ORDER BY met DESC, model LIMIT 1) f"""

_BT_OVERLAP = _BOARDS + """, ends AS (SELECT model, quantile_cont(s, 0.025) lo, quantile_cont(s, 0.975) hi FROM r WHERE b >= 0 GROUP BY 1),
gaps AS (SELECT u.model a, v.model c, quantile_cont(u.s - v.s, 0.025) lo, quantile_cont(u.s - v.s, 0.975) hi FROM r u JOIN r v USING (b) WHERE u.b >= 0 AND u.model <> v.model GROUP BY 1, 2)
SELECT a model_a, c model_b, g.lo > 0 OR g.hi < 0 separable, e.hi < f.lo OR f.hi < e.lo apart
FROM gaps g JOIN point x ON x.model = a JOIN point y ON y.model = c AND x.s > y.s JOIN ends e ON e.model = a JOIN ends f ON f.model = c"""

_LENGTH_FIT = _with("v_len", f"SELECT n, n_disagreements, {_r('longer')} longer_rate, {_r('f1.b1', 5)} coefficient, {_r(f'f1.b1 - {_ZA} * f1.se', 5)} ci_low, {_r(f'f1.b1 + {_ZA} * f1.se', 5)} ci_high, {_r('f2.b1', 5)} disagreement_coefficient, {_r(f'f2.b1 - {_ZA} * f2.se', 5)} disagreement_ci_low, {_r(f'f2.b1 + {_ZA} * f2.se', 5)} disagreement_ci_high FROM (SELECT count(*) n, sum(y2)::BIGINT n_disagreements, avg(CASE WHEN y1 = 1 THEN (x1 > 0)::INT ELSE (x1 < 0)::INT END) longer FROM p) s, fit1 f1, fit2 f2", _LEN, *_newton(1), *_newton(2))

#: What q_refusals' cases say of their arguments alone.
_REFUSED = {
    "wilson of prices": "the Wilson interval is for 0/1 scores; use method='bootstrap'",
    "t of passes": "the t interval is not for 0/1 scores; use method='wilson'",
    "confidence of one": "confidence must lie strictly between 0 and 1, not 1.0",
    "no resamples": "n_boot must be at least 1, not 0",
    "method unknown": "method must be one of 'auto', 'mcnemar', 'bootstrap', 'wilcoxon', not 'sign'",
    "mcnemar of cents": "McNemar's test is for 0/1 scores; use method='bootstrap' or 'wilcoxon'",
    "score interval of prices": "the score interval is for 0/1 scores; use method='bootstrap' or 't'",
    "labels as numbers": "level='ordinal' needs numeric ratings; map the labels to numbers or use level='nominal'",
    "no ratings": "ratings must not be empty",
    "ties without baseline": "ties is about the human baseline; pass human_baseline too",
    "baseline without ties": "say what ties are in the human baseline: ties='category' or ties='drop'",
    "ordinal baseline": "the human baseline is for nominal labels",
    "davidson ties": "ties='davidson' is not available; use 'split' or 'drop'",
    "power under alpha": "power must exceed alpha: a test that never looks at the data reaches alpha",
    "effect above discordance": "a difference of 0.4 cannot come from systems that differ on only 0.3 of the items",
    "half an item": "n must be a whole number of at least 2, not 10.5",
    "audit of nothing": "an audit needs scores, comparisons, ratings, labels or preferences",
    "field unknown": "the config has no field(s) seeds; it has claim, claims_direction, effect_of_interest, confidence, level, agreement_threshold, judge_threshold, power, alpha, paired, discordance_rate, n_boot, seed",
}
#: And what those say of the rows.
_REFUSED_ROWS = {
    "score not finite": "SELECT 'scores has ' || count(*) FILTER (score = 1) || ' of ' || count(*) || ' rows without a finite score, the first item ' || min(item_id) FILTER (score = 1) || '; drop or fill them first' FROM v_indep",
    "rating twice": "SELECT 'item_id=' || item_id || ', rater_id=' || chr(39) || rater_id || chr(39) || ' occurs ' || 2 * count(*) || ' times; two ratings of one rater on one item would count that opinion twice' FROM v_ratings GROUP BY item_id, rater_id ORDER BY item_id, rater_id LIMIT 1",
    "rater missing": "SELECT 'ratings has ' || count(*) || ' row(s) whose rater_id is missing' FROM v_ratings WHERE rater_id = 'h0'",
    "item in two clusters": "SELECT 'human_baseline: item_id=' || item_id || ' has ' || count(DISTINCT rater_id) || ' different values of cluster_id' FROM v_base GROUP BY item_id HAVING count(DISTINCT rater_id) > 1 ORDER BY item_id LIMIT 1",
    "baseline beyond the judged": "SELECT 'human_baseline has ' || count(DISTINCT item_id) || ' item(s) that are not among the judged items' FROM v_base WHERE item_id % 2 <> 0",
    "winner not compared": "SELECT count(*) || ' comparison(s) have a winner that was not compared' FROM v_lb",
    "model against itself": "SELECT count(*) || ' comparison(s) compare a model with itself' FROM v_lb",
    "model called tie": "SELECT count(*) || ' comparison(s) name a model ''tie'', which is how a tie is spelled' FROM v_lb",
    "winner not shown": "SELECT count(*) || ' comparison(s) have a winner that was not on offer; leave it empty for a tie' FROM v_pos_random",
    "pair missing": "SELECT 'comparisons has ' || count(*) || ' row(s) whose pair_id is missing' FROM v_pos_random",
    "many rows a key": "SELECT 'item_id=' || item_id || ' occurs ' || count(*) || ' times; the right side of this join needs one row a key' FROM v_ratings GROUP BY item_id HAVING count(*) > 1 ORDER BY item_id LIMIT 1",
}
_REFUSALS = _with("v_indep v_ratings v_base v_lb v_pos_random", "\nUNION ALL ".join([*(f"""SELECT '{case}' "case", ({select}) refusal""" for case, select in _REFUSED_ROWS.items()), *(f"""SELECT '{case}', '{text.replace("'", "''")}'""" for case, text in _REFUSED.items())]))

#: The audit's findings from the figures of other queries; the config's lines are the defaults, the effect of interest 0.05.
_LINE = "0.667"


def _against_line(check: str, subject: str) -> str:
    later = subject[0].lower() + subject[1:]
    return f"""SELECT '{check}' "check", CASE WHEN ci_low > {_LINE} THEN 'info' ELSE 'warning' END severity,
  CASE WHEN ci_high < {_LINE} THEN '{subject} falls short of {_LINE}' WHEN ci_low > {_LINE} THEN '{subject} clears {_LINE}' ELSE 'The data cannot show that {later} clears {_LINE}' END title"""


_MARGIN = f"SELECT difference d, ci_low lo, ci_high hi FROM ({_TANGO}) x"
_SIZE = _with("v_paired", "SELECT count(*) n, avg((q.a <> q.b)::INT) r FROM v_paired q")
_AUDIT = f"""WITH m AS ({_MARGIN}), s AS (SELECT *, CASE WHEN n - {_ZA**2} + {_ZB**2} >= 0 THEN sqrt(r) * ({_ZA} * sqrt(n) + {_ZB} * sqrt(n - {_ZA**2} + {_ZB**2})) / (n + {_ZB**2}) END reach FROM ({_SIZE}) x),
j AS ({_JUDGED}), jall AS (SELECT * FROM j WHERE slice = '(all)'), worst AS (SELECT * FROM j WHERE slice <> '(all)' ORDER BY agreement NULLS LAST, slice LIMIT 1),
l AS ({_LENGTH_FIT}),
found AS (
  SELECT 1 k, 'compare' "check", CASE WHEN lo <= 0 AND hi >= 0 THEN 'critical' ELSE 'info' END severity, CASE WHEN lo <= 0 AND hi >= 0 THEN 'The margin does not exclude zero' ELSE 'The margin excludes zero' END title FROM m
  UNION ALL SELECT 2, 'power', CASE WHEN NOT (lo <= 0 AND hi >= 0) OR (reach <= r AND reach <= 0.05) OR (-0.05 < lo AND hi < 0.05) THEN 'info' ELSE 'critical' END,
    CASE WHEN NOT (lo <= 0 AND hi >= 0) THEN 'The margin is established; more items would only narrow it' WHEN reach <= r AND reach <= 0.05 THEN 'The evaluation was large enough for the effect of interest'
         WHEN -0.05 < lo AND hi < 0.05 THEN 'The margin''s interval rules the effect of interest out' ELSE 'The evaluation had under 80% power for the effect of interest' END FROM m, s
  UNION ALL SELECT 3, * FROM ({_against_line("agreement", "Agreement between raters")} FROM ({_agreement("nominal")}) x) a
  UNION ALL SELECT 4, "check", CASE WHEN w THEN 'critical' ELSE severity END, CASE WHEN w THEN 'The judge fails on slice ' || slice ELSE title END
    FROM ({_against_line("judge", "The judge''s agreement with humans")} FROM jall) a, (SELECT worst.slice, coalesce(worst.ci_high < jall.ci_low, false) w FROM worst, jall) b
  UNION ALL SELECT 5, 'position', CASE WHEN ci_low > 0.5 OR ci_high < 0.5 THEN 'warning' ELSE 'info' END, CASE WHEN ci_low > 0.5 OR ci_high < 0.5 THEN 'The place shown moves the verdict' ELSE 'No effect of place could be shown' END FROM ({_POSITION}) x WHERE design = 'randomised'
  UNION ALL SELECT 6, 'length', CASE WHEN disagreement_ci_low > 0 OR disagreement_ci_high < 0 THEN 'warning' ELSE 'info' END,
    CASE WHEN disagreement_ci_low > 0 THEN 'The judge is drawn to longer options' WHEN disagreement_ci_high < 0 THEN 'The judge is drawn to shorter options' ELSE 'No effect of length could be shown' END FROM l
  UNION ALL SELECT 7, 'scores', 'info', 'Score of a' UNION ALL SELECT 8, 'scores', 'info', 'Score of b')
SELECT row_number() OVER (ORDER BY list_position(['critical', 'warning', 'info'], severity), k) - 1 AS at, "check", severity, title FROM found"""

SQL: dict[str, str] = {
    "q_score_ci": _SCORE_CI,
    "q_compare_paired": _COMPARE_PAIRED,
    "q_compare_independent": _COMPARE_INDEPENDENT,
    "q_signed_null": _NULL,
    "q_power": _POWER,
    "q_special_functions": _SPECIAL,
    "q_alpha_one_value": _with("v_ratings", _ALPHA_OUT, "src AS (SELECT item_id, 'same' rating FROM v_ratings)", *_alpha("src", "nominal")),
    "q_ratings_clean": _with("v_ratings", "SELECT rating, count(*) n FROM (SELECT rating FROM v_ratings WHERE rating <> 'view' UNION ALL SELECT concat(rating_num::VARCHAR, '.5') FROM v_ratings) x GROUP BY 1"),
    **{f"q_rater_agreement_{level}": _agreement(level) for level in ("nominal", "ordinal", "interval")},
    "q_judge_validation": _JUDGED,
    "q_judge_baseline": _JUDGE_BASELINE,
    "q_baseline_rules_drop": _with("v_base v_base_judge", "SELECT rule, count(*) n_items, sum(n)::BIGINT n_humans FROM (SELECT n, CASE WHEN judge IS NULL THEN 'no_judge_label' WHEN n < 2 THEN 'too_few_humans' WHEN judge = 'click' THEN 'judge_tie' ELSE 'kept' END AS rule FROM (SELECT item_id, count(*) FILTER (rating <> 'click') n FROM v_base GROUP BY 1) x LEFT JOIN v_base_judge USING (item_id)) y GROUP BY 1"),
    "q_position_bias": _POSITION,
    "q_bt_credit_drop": _with("v_lb", f"SELECT i, j, {_r('sum(c)')} credit FROM (SELECT model_a i, model_b j, (winner = model_a)::INT c FROM v_lb WHERE winner <> 'tie' UNION ALL SELECT model_b, model_a, (winner = model_b)::INT FROM v_lb WHERE winner <> 'tie') x GROUP BY 1, 2"),
    "q_bt_boot_credit": _with("v_lb", f"SELECT b, i, j, {_r('credit')} credit FROM cb WHERE credit > 0", _ITEM_CREDIT, *_keyed("v_lb", "item_id", 1000), _BOOT_CREDIT),
    "q_bt_pairs": _BT_PAIRS,
    "q_bt_overlap": _BT_OVERLAP,
    "q_bt_rating_intervals": _BT_INTERVALS,
    "q_bt_ends": _with("v_lb", "SELECT max(greatest(model_a, model_b)) undefeated, min(least(model_a, model_b)) winless, true connected, 0::BIGINT n_rated FROM v_lb"),
    "q_join_inner": _with("v_sparse v_base_judge", "SELECT judge, count(*) n, count(DISTINCT item_id) n_items FROM v_sparse JOIN v_base_judge USING (item_id) WHERE judge <> 'view' GROUP BY 1"),
    "q_winner_names": _with("v_lb", "SELECT winner, count(*) n FROM v_lb GROUP BY 1"),
    "q_refusals": _REFUSALS,
    "q_audit": _AUDIT,
    "q_design_effect": _DESIGN_EFFECT,
    "q_coverage": _with("v_indep", f"SELECT grp, count(*) n_batches, {_r('avg((lo <= truth AND truth <= hi)::INT)')} covered, {_r('avg((lo > truth)::INT)')} missed_below, {_r('avg((hi < truth)::INT)')} missed_above FROM (SELECT grp, greatest((p + {Z * Z} / (2 * n) - {_W}) / (1 + {Z * Z} / n), 0) lo, least((p + {Z * Z} / (2 * n) + {_W}) / (1 + {Z * Z} / n), 1) hi FROM (SELECT grp, floor(item_id / 400) batch, count(*) n, avg(score) p FROM v_indep GROUP BY 1, 2) x) y JOIN (SELECT grp, avg(score) truth FROM v_indep GROUP BY 1) z USING (grp) GROUP BY 1"),
    "q_coverage_paired": _COVERAGE_PAIRED,
    "q_coverage_two_sample": _with("v_indep", f"SELECT count(*) n_batches, {_r('avg((lo <= truth AND truth <= hi)::INT)')} covered FROM (SELECT batch, quantile_cont(d, 0.025) lo, quantile_cont(d, 0.975) hi FROM (SELECT batch, b, sum(CASE WHEN grp = '1-URGENT' THEN w * score END) / nullif(sum(CASE WHEN grp = '1-URGENT' THEN w END), 0) - sum(CASE WHEN grp = '5-LOW' THEN w * score END) / nullif(sum(CASE WHEN grp = '5-LOW' THEN w END), 0) d FROM rows JOIN wt ON k = item_id GROUP BY 1, 2) x GROUP BY 1 HAVING count(d) >= 180) y, (SELECT avg(CASE WHEN grp = '1-URGENT' THEN score END) - avg(CASE WHEN grp = '5-LOW' THEN score END) truth FROM v_indep) t", "rows AS (SELECT *, floor(item_id / 2000)::BIGINT batch FROM v_indep)", *_keyed("v_indep", "item_id", 200)),
    "q_tango_ci": _TANGO,
    "q_score_diff_ci": _MEE,
    "q_power_indep_grid": _POWER_INDEP,
    "q_bt_ratings": _MM + f"SELECT model, {_r('rating', 5)} rating, {_r('total')} n_comparisons FROM rated",
    "q_bt_elo": _MM + f"SELECT model, {_r('1500 + rating * 400 / ln(10)', 3)} rating FROM rated",
    "q_bt_win_matrix": _MM + f"SELECT a.model model_a, b.model model_b, {_r('1 / (1 + exp(b.rating - a.rating))', 5)} p FROM rated a JOIN rated b ON a.model <> b.model",
    "q_length_fit": _LENGTH_FIT,
    "q_plain_paired_intervals": _with("v_paired", _PLAIN),
    "q_score_wilson": _with("v_indep", f"SELECT grp, n, {_r('p')} estimate, {_r(f'greatest((p + {Z * Z} / (2 * n) - {_W}) / (1 + {Z * Z} / n), 0)')} ci_low, {_r(f'least((p + {Z * Z} / (2 * n) + {_W}) / (1 + {Z * Z} / n), 1)')} ci_high FROM (SELECT grp, count(*) n, avg(score) p FROM v_indep GROUP BY 1) x"),
    "q_score_t": _with("v_indep", f"SELECT grp, n, {_r('m', 1)} mean, {_r('s', 1)} sd, {_r('s / sqrt(n)', 1)} se, {_r(f'm - {Z} * s / sqrt(n)', 1)} ci_low, {_r(f'm + {Z} * s / sqrt(n)', 1)} ci_high FROM (SELECT grp, count(*) n, avg(score_cont) m, stddev_samp(score_cont) s FROM v_indep GROUP BY 1) x"),
    "q_score_checks": _with("v_indep", "SELECT grp, kind, count(*) n, bool_and(x IN (0, 1)) AS binary, min(x) = max(x) AS constant FROM (SELECT grp, 'score' kind, score::DOUBLE x FROM v_indep UNION ALL SELECT grp, 'score_cont', score_cont FROM v_indep) y GROUP BY 1, 2"),
    "q_mcnemar_counts": _with("v_paired", f"SELECT n, b n_a_only, c n_b_only, b + c n_discordant, {_r('(b - c) / n')} difference, {_r('CASE WHEN b + c >= 25 THEN (abs(b - c) - 1) ** 2 / (b + c) END')} statistic FROM (SELECT count(*) n, count(*) FILTER (a = 1 AND b = 0) b, count(*) FILTER (a = 0 AND b = 1) c FROM v_paired) x"),
    "q_mcnemar_exact": _with("v_paired", f"""SELECT size, batch, total n, b n_a_only, c n_b_only, n < 25 exact, {_r(f"CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN {_BINOMIAL} ELSE {_normal_two('(abs(b - c) - 1) / sqrt(n)')} END")} p_value
FROM (SELECT *, b + c n, b k FROM (SELECT size, floor(q.item_id / size)::BIGINT batch, count(*) total, count(*) FILTER (q.a = 1 AND q.b = 0)::BIGINT b, count(*) FILTER (q.a = 0 AND q.b = 1)::BIGINT c FROM v_paired q, unnest([40::BIGINT, 4000]) s(size) GROUP BY 1, 2) y) x"""),
    "q_two_prop_z_stat": _with("v_indep", f"SELECT n1, n2, {_r('k1 / n1 - k2 / n2')} difference, {_r('(k1 / n1 - k2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2))')} z FROM (SELECT *, (k1 + k2) / (n1 + n2) p FROM (SELECT count(*) FILTER (grp = '1-URGENT') n1, count(*) FILTER (grp = '5-LOW') n2, sum(CASE WHEN grp = '1-URGENT' THEN score END)::DOUBLE k1, sum(CASE WHEN grp = '5-LOW' THEN score END)::DOUBLE k2 FROM v_indep) x) y"),
    "q_welch_stats": _with("v_indep", f"SELECT {_r('m1 - m2', 2)} difference, {_r('sqrt(e1 + e2)', 3)} se, {_r('(e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))', 3)} df FROM (SELECT avg(x) m1, var_samp(x) / count(x) e1, count(x) n1, avg(y) m2, var_samp(y) / count(y) e2, count(y) n2 FROM (SELECT CASE WHEN grp = '1-URGENT' THEN score_cont END x, CASE WHEN grp = '5-LOW' THEN score_cont END y FROM v_indep) q) w"),
    "q_wilcoxon_ranks": _with("v_paired", f"SELECT sum(t)::BIGINT n, {_r('sum(mid * pos)')} w_positive, {_r('sum(mid * (t - pos))')} w_negative, {_r('sum(t * t * t - t)')} tie_correction FROM (SELECT t, pos, coalesce(sum(t) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 mid FROM (SELECT abs(x) s, sum(n) t, sum(CASE WHEN x > 0 THEN n ELSE 0 END) pos FROM z GROUP BY 1) q) y", _CENTS),
    "q_walsh_averages": _with("v_paired", f"SELECT {_r('w')} w, n FROM w", _CENTS, _WALSH),
    "q_hodges_lehmann": _with("v_paired", f"""SELECT n::BIGINT n, {_r("((SELECT min(w) FROM c WHERE upto > (total - 1) // 2) + (SELECT min(w) FROM c WHERE upto > total // 2)) / 2")} difference,
  {_r("(SELECT min(w) FROM c WHERE upto > k)")} ci_low, {_r("(SELECT min(w) FROM c WHERE upto > total - 1 - k)")} ci_high
FROM (SELECT n, n * (n + 1) // 2 total, least(greatest(floor(n * (n + 1) / 4 - {_ZA} * sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)), 0), (total - 1) // 2)::BIGINT k
  FROM (SELECT sum(t)::BIGINT n, sum(t * t * t - t)::DOUBLE ties FROM (SELECT abs(x) s, sum(n)::BIGINT t FROM z GROUP BY 1) q) y) v""", _CENTS, _WALSH, "c AS (SELECT w, sum(n) OVER (ORDER BY w) upto FROM w)"),
    "q_min_n_grid": _with("v_paired", f"""SELECT batch, {_r("base")} baseline, {_r("r")} discordance_rate, {_r("m / 50")} mde,
  CASE WHEN m / 50 <= r THEN ceil((({_ZA} * sqrt(r) + {_ZB} * sqrt(greatest(r - (m / 50) ** 2, 0))) / (m / 50)) ** 2)::BIGINT END n_paired,
  CASE WHEN base + m / 50 <= 1 THEN 2 * ceil((({_ZA} * sqrt(2 * (base + m / 100) * (1 - base - m / 100)) + {_ZB} * sqrt(base * (1 - base) + (base + m / 50) * (1 - base - m / 50))) / (m / 50)) ** 2)::BIGINT END n_independent
FROM designs, unnest(range(1, 16)) z(m)""", _DESIGNS),
    "q_power_paired_grid": _with("v_paired", f"""SELECT batch, n, {_r("r")} discordance_rate, {_r("d")} difference, coalesce(d <= r, false) attainable FROM (
  SELECT batch, n, r, CASE WHEN n - {_ZA**2} + {_ZB**2} >= 0 THEN sqrt(r) * ({_ZA} * sqrt(n) + {_ZB} * sqrt(n - {_ZA**2} + {_ZB**2})) / (n + {_ZB**2}) END d FROM designs) q""", _DESIGNS),
    "q_alpha_nominal": _with("v_ratings", _ALPHA_OUT, *_alpha("v_ratings", "nominal")),
    "q_alpha_ordinal": _with("v_ratings", _ALPHA_OUT, "src AS (SELECT item_id, rating_num::DOUBLE rating FROM v_ratings)", *_alpha("src", "ordinal")),
    "q_alpha_interval": _with("v_ratings", _ALPHA_OUT, "src AS (SELECT item_id, rating_num::DOUBLE rating FROM v_ratings)", *_alpha("src", "interval")),
    "q_alpha_sparse": _with("v_sparse", _ALPHA_OUT, *_alpha("v_sparse", "nominal")),
    "q_item_disagreement": _with("v_ratings", f"SELECT item_id, m::BIGINT n_ratings, {_r('o / m')} disagreement, {_r('o / m / nullif(e / nullif(n * (n - 1), 0), 0)')} vs_chance FROM units, chance", *_alpha("v_ratings", "nominal")),
    "q_rater_dropout": _dropout("src", "nominal"),
    "q_rater_dropout_ordinal": _dropout("src", "ordinal"),
    "q_cohen_kappa": _with("v_ratings", f"SELECT n n_items, k n_categories, {_r('po')} p_observed, {_r('pe')} p_expected, {_r('(po - pe) / nullif(1 - pe, 0)')} kappa FROM (SELECT count(*) n, avg((x = y)::INT) po FROM p) a, (SELECT count(*) k, sum(f.c * g.c)::DOUBLE / (SELECT count(*) ** 2 FROM p) pe FROM (SELECT v, count(CASE WHEN s = 1 THEN 1 END) c FROM q GROUP BY 1) f JOIN (SELECT v, count(CASE WHEN s = 2 THEN 1 END) c FROM q GROUP BY 1) g USING (v)) b", "p AS (SELECT a.rating x, b.rating y FROM v_ratings a JOIN v_ratings b USING (item_id) WHERE a.rater_id = 'h0' AND b.rater_id = 'h1')", "q AS (SELECT x v, 1 s FROM p UNION ALL SELECT y, 2 FROM p)"),
    "q_fleiss_kappa": _with("v_ratings", f"SELECT n_items, least, most, {_r('po')} p_observed, {_r('pe')} p_expected, n_categories, {_r('(po - pe) / nullif(1 - pe, 0)')} kappa FROM (SELECT count(*) n_items, min(m)::BIGINT AS least, max(m)::BIGINT AS most, avg((c2 - m) / (m * (m - 1))) po FROM (SELECT item_id, sum(c)::DOUBLE m, sum(c * c) c2 FROM c GROUP BY 1) x) a, (SELECT sum(g * g) / sum(g) ** 2 pe, count(*) n_categories FROM (SELECT rating, sum(c)::DOUBLE g FROM c GROUP BY 1) y) b", "c AS (SELECT item_id, rating, count(*) c FROM v_ratings GROUP BY 1, 2)"),
    "q_judge_overall": _with("v_judge", f"SELECT n_items, {_r('accuracy')} accuracy, {_r('alpha')} alpha FROM (SELECT count(*) n_items, avg((human = judge)::INT) accuracy FROM v_judge) x, alpha", "src AS (SELECT item_id, human rating FROM v_judge UNION ALL SELECT item_id, judge FROM v_judge)", *_alpha("src", "nominal")),
    "q_judge_slices": _with("v_judge", f"SELECT slice, x.n_items, {_r('accuracy')} accuracy, {_r('alpha')} alpha, CASE WHEN x.n_items < 2 THEN 'one item, too few to measure agreement' WHEN n_values <= 1 THEN 'human and judge used one label throughout, so alpha has no denominator' ELSE '' END note FROM (SELECT slice, count(*) n_items, avg((human = judge)::INT) accuracy FROM v_judge GROUP BY 1) x JOIN alpha USING (slice)", "src AS (SELECT slice, item_id, human rating FROM v_judge UNION ALL SELECT slice, item_id, judge FROM v_judge)", *_alpha("src", "nominal", "slice")),
    "q_baseline_rules": _with("v_base v_base_judge", "SELECT rule, count(*) n_items, count(DISTINCT cluster_id) n_clusters FROM (SELECT cluster_id, CASE WHEN judge IS NULL THEN 'no_judge_label' WHEN n < 2 THEN 'too_few_humans' ELSE 'kept' END AS rule FROM (SELECT item_id, any_value(cluster_id) cluster_id, count(rating) n FROM v_base GROUP BY 1) x LEFT JOIN v_base_judge j USING (item_id)) y GROUP BY 1"),
    "q_baseline_alphas": _with("v_base v_base_judge", f"SELECT {_r('judge_human')} judge_human, {_r('human_human')} human_human, {_r('difference')} difference FROM ({_two_alphas('(SELECT sum(hh_o) hh_o, sum(jh_o) jh_o FROM obs) o', '(SELECT v, sum(hh) hh, sum(jh) jh FROM marg GROUP BY 1) m', '')}) q", *_BASE),
    "q_position_design": _with("v_pos_random v_pos_both", "\nUNION ALL\n".join(f"SELECT '{name}' pairs, n_pairs, n_both_orders, CASE WHEN n_both_orders > 0 AND n_both_orders >= 0.5 * n_pairs THEN 'both_orders' ELSE 'randomised' END design FROM (SELECT count(DISTINCT pair_id) n_pairs, (SELECT count(DISTINCT x.pair_id) FROM {view} x JOIN {view} y ON x.pair_id = y.pair_id AND x.option_a = y.option_b AND x.option_b = y.option_a) n_both_orders FROM {view}) q" for name, view in (("pair_id", "v_pos_random"), ("item_id", "v_pos_both")))),
    "q_position_randomised": _with("v_pos_random", f"SELECT count(*) n_judgements, count(winner) n_decisive, count(*) - count(winner) n_ties, count(*) FILTER (winner = option_a) n_a_wins, {_r('count(*) FILTER (winner = option_a) / count(winner)')} rate FROM v_pos_random"),
    "q_position_couples": _with("v_pos_both", "SELECT * FROM couples", *_COUPLES),
    "q_position_exact_p": _with("v_pos_both", f"SELECT n n_flipped, k n_first, {_r(f'CASE WHEN n > 0 THEN {_BINOMIAL} END')} p_value FROM (SELECT count(*) FILTER (NOT consistent)::BIGINT n, count(*) FILTER (NOT consistent AND to_first)::BIGINT k FROM couples) x", *_COUPLES),
    "q_length_stats": _with("v_len", f"{_outcomes(1, 'preference')}\nUNION ALL\n{_outcomes(2, 'disagreement')}", _LEN),
    "q_bt_credit": _with("v_lb", f"SELECT i, j, {_r('credit')} credit FROM credit", _CREDIT),
    "q_bt_totals_reference": _with("v_lb", f"SELECT model, {_r('n')} n_comparisons, {_r('c')} credit, row_number() OVER (ORDER BY n DESC, model) = 1 is_reference FROM (SELECT i model, sum(credit) c, sum(credit) + (SELECT sum(credit) FROM credit y WHERE y.j = x.i) n FROM credit x GROUP BY 1) q", _CREDIT),
    "q_bt_components": _with("v_lb", "SELECT split_part(model, ':', 1) board, split_part(model, ':', 2) model, split_part(min(other), ':', 2) group_first, count(*) size FROM (SELECT a model, b other FROM reach UNION SELECT a, a FROM reach) x GROUP BY model", "both_boards AS (SELECT 'all:' || model_a a, 'all:' || model_b b FROM v_lb UNION SELECT 'islands:' || model_a || '@' || item_id % 3, 'islands:' || model_b || '@' || item_id % 3 FROM v_lb)", "edge AS (SELECT a, b FROM both_boards UNION SELECT b, a FROM both_boards)", "reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)").replace("WITH ", "WITH RECURSIVE ", 1),
    "q_raw_pair_agreement": _with("v_ratings", f"SELECT count(*) n_units, sum(m * (m - 1) // 2)::BIGINT n_pairs, sum(same)::BIGINT n_agreeing, {_r('avg(same / (m * (m - 1) / 2))')} mean_share, {_r('sum(same) / sum(m * (m - 1) // 2)')} pooled_share FROM (SELECT item_id, sum(c)::BIGINT m, sum(c * (c - 1) // 2)::BIGINT same FROM (SELECT item_id, rating, count(*) c FROM v_ratings GROUP BY 1, 2) x GROUP BY 1 HAVING sum(c) >= 2) y"),
    "q_plurality": _with("v_ratings", "SELECT item_id, sum(c)::BIGINT n, CASE WHEN count(*) FILTER (c = top) > 1 THEN 'tie' ELSE max_by(rating, c) END verdict FROM (SELECT *, max(c) OVER (PARTITION BY item_id) top FROM (SELECT item_id, rating, count(*) c FROM v_ratings GROUP BY 1, 2) x) y GROUP BY 1"),
    "q_first_vote": _with("v_lb", "SELECT item_id, model_a, model_b, seq, winner FROM v_lb QUALIFY row_number() OVER (PARTITION BY item_id, model_a, model_b ORDER BY seq) = 1"),
    "q_multi_judge_units": _with("v_sparse", "SELECT item_id, rater_id, rating FROM v_sparse WHERE item_id IN (SELECT item_id FROM v_sparse GROUP BY 1 HAVING count(DISTINCT rater_id) >= 2)"),
    "q_join_judge": _with("v_base v_base_judge", "SELECT cluster_id, count(*) n, count(judge) n_judged, count(*) FILTER (judge = rating) n_same FROM v_base LEFT JOIN v_base_judge j USING (item_id) GROUP BY 1"),
    "q_codings": _with("v_lb", "SELECT winner by_name, CASE WHEN winner = 'tie' THEN 'tie' WHEN winner = least(model_a, model_b) THEN 'first' ELSE 'second' END by_alphabet, CASE WHEN winner = 'tie' THEN 'tie' WHEN winner = model_a THEN 'first' ELSE 'second' END by_place, count(*) n FROM v_lb GROUP BY ALL"),
    "q_unordered_pairs": _with("v_lb", "SELECT least(model_a, model_b) low, greatest(model_a, model_b) high, count(*) n FROM v_lb GROUP BY ALL"),
    "q_funnel": _with("v_judge", "SELECT 0 AS at, 'all' step, count(*) n FROM v_judge UNION ALL SELECT 1, 'judged good', count(*) FILTER (judge = 1) FROM v_judge UNION ALL SELECT 2, 'human agrees', count(*) FILTER (judge = 1 AND human = 1) FROM v_judge UNION ALL SELECT 3, 'english', count(*) FILTER (judge = 1 AND human = 1 AND slice = 'en') FROM v_judge"),
}
