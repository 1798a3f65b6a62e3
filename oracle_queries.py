"""ANSI SQL of every registered query that SQL can express, for DuckDB."""

from __future__ import annotations

from twinframe.functions.normal import normal_cdf_sql, probit_sql, probit_tail_sql

SEEDS = (42, 123, 456)
HASH_RANGE = "4503599627370496e0"

HOUSEHOLD = """
totals AS MATERIALIZED (
  SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend, max(o_totalprice) AS max_order,
         sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_totalprice ELSE 0 END)
           AS urgent_pending
  FROM orders GROUP BY o_custkey),
household AS MATERIALIZED (
  SELECT c_custkey, c_acctbal, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS spend,
         coalesce(max_order, 0) AS max_order, coalesce(urgent_pending, 0) AS urgent_pending,
         c_mktsegment, r_name,
         CAST(ntile(5) OVER (ORDER BY coalesce(spend, 0), c_custkey) AS VARCHAR) AS spend_quintile,
         CASE WHEN c_custkey % 2 = 0 THEN 'real' ELSE 'synth' END AS side
  FROM customer LEFT JOIN totals ON c_custkey = o_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LINE_COLUMNS = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus, "
    "CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synth' END AS side"
)
LINES = f"""
pair AS (SELECT {LINE_COLUMNS}, l_extendedprice, l_returnflag FROM lineitem)"""
SHIFTED = f"""
pair AS (
  SELECT {LINE_COLUMNS},
         CASE WHEN l_orderkey % 2 = 1 THEN l_extendedprice * 1.1e0 ELSE l_extendedprice END
           AS l_extendedprice,
         CASE WHEN l_orderkey % 2 = 1 AND l_quantity > 40 THEN 'R' ELSE l_returnflag END AS l_returnflag
  FROM lineitem)"""
PAIR_ORDERS = """
pair AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'synth' END AS side FROM orders)"""

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]
HH_NUMERIC = ["c_acctbal", "n_orders", "spend", "max_order", "urgent_pending"]
HH_CATEGORICAL = ["c_mktsegment", "r_name", "spend_quintile"]


def r4(x: str, digits: int = 4) -> str:
    return f"(CASE WHEN abs({x}) < 0.5e-{digits} THEN 0e0 ELSE round({x}, {digits}) END)"


def long(source: str, columns: list[str], keep: str = "", name: str = "value", cast: str = "DOUBLE") -> str:
    lead = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS col, CAST({c} AS {cast}) AS {name} FROM {source}" for c in columns
    )


def probit_cte(out: str, source: str, p: str, z: str) -> str:
    return (
        f"{out}_tail AS MATERIALIZED (SELECT *, {probit_tail_sql(p)} AS tail_ FROM {source}), "
        f"{out} AS MATERIALIZED (SELECT * EXCLUDE (tail_), {probit_sql(p, 'tail_')} AS {z} FROM {out}_tail)"
    )


def levels_ctes(source: str, columns: list[str]) -> str:
    counted = f"""
lv_counts AS (SELECT col, level, count(*) AS n FROM ({long(source, columns, '', 'level', 'VARCHAR')})
              GROUP BY col, level),
lv_index AS (SELECT col, level, n, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY col) AS k,
                    CAST(sum(n) OVER w - n AS BIGINT) AS below,
                    CAST(sum(n) OVER (PARTITION BY col) AS BIGINT) AS total
             FROM lv_counts WINDOW w AS (PARTITION BY col ORDER BY level)),
lv_middle AS (SELECT *, (idx + 0.5e0) / k AS mid_ FROM lv_index),"""
    return counted + probit_cte("levels", "lv_middle", "mid_", "center")


def grid_ctes(source: str, columns: list[str]) -> str:
    return f"""
ranked AS MATERIALIZED (
  SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS rk,
         count(*) OVER (PARTITION BY col) AS n FROM ({long(source, columns)})),
sized AS (SELECT DISTINCT col, n, least(n, 2000) - 1 AS cells FROM ranked),
spots AS (SELECT col, n, cells, j, (j * (n - 1)) // cells AS lo, ((j * (n - 1)) % cells) / CAST(cells AS DOUBLE) AS part
          FROM sized, range(2000) t(j) WHERE j <= cells),
refs AS MATERIALIZED (
  SELECT s.col, s.j, s.cells,
         a.value + CASE WHEN s.part > 0 THEN (b.value - a.value) * s.part ELSE 0 END AS value
  FROM spots s JOIN ranked a ON a.col = s.col AND a.rk = s.lo
       LEFT JOIN ranked b ON b.col = s.col AND b.rk = s.lo + 1),
grid AS MATERIALIZED (
  SELECT col, value, min(j) / CAST(max(cells) AS DOUBLE) AS p_min, max(j) / CAST(max(cells) AS DOUBLE) AS p_max
  FROM refs GROUP BY col, value),
grid_next AS MATERIALIZED (
  SELECT *, lead(value) OVER w AS next_value, lead(p_min) OVER w AS next_p,
         min(value) OVER (PARTITION BY col) AS lowest, max(value) OVER (PARTITION BY col) AS highest
  FROM grid WINDOW w AS (PARTITION BY col ORDER BY value))"""


def score_ctes(source: str, columns: list[str], ids: str) -> str:
    """(ids, col, z): standardised clipped normal scores; and the state table ``stats``."""
    joined = ids.replace(" ", "").split(",")
    lead = ", ".join(f"v.{i}" for i in joined)
    return f"""
vals AS ({long(source, columns, ids)}),
placed AS (
  SELECT {lead}, v.col, v.value,
         CASE WHEN v.value < g.lowest + 1e-7 THEN 0e0
              WHEN v.value > g.highest - 1e-7 THEN 1e0
              WHEN v.value = g.value THEN (g.p_min + g.p_max) / 2
              ELSE g.p_max + (v.value - g.value) / (g.next_value - g.value) * (g.next_p - g.p_max) END AS raw_p
  FROM vals v ASOF JOIN grid_next g ON v.col = g.col AND v.value >= g.value),
safe AS (SELECT *, greatest(1e-7, least(1 - 1e-7, raw_p)) AS p_ FROM placed),
{probit_cte('probed', 'safe', 'p_', 'raw_z')},
scores AS MATERIALIZED (SELECT *, greatest(-4.5e0, least(4.5e0, raw_z)) AS score FROM probed),
stats AS MATERIALIZED (
  SELECT col, avg(score) AS mean, coalesce(nullif(stddev_pop(score), 0), 1) AS scale,
         min(value) AS minimum, max(value) AS maximum FROM scores GROUP BY col),
latent AS MATERIALIZED (
  SELECT s.*, (s.score - t.mean) / t.scale AS z FROM scores s JOIN stats t USING (col))"""


def latents_cte(source: str, numeric: list[str], categorical: list[str], ids: str) -> str:
    """(ids, dim, col, z): the whole latent table in long form."""
    names = ids.replace(" ", "").split(",")
    lead = ", ".join(f"v.{i}" for i in names)
    dims = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate([*numeric, *categorical]))
    return f"""
latents AS MATERIALIZED (
  SELECT {ids}, CASE col {dims} END AS dim, col, z FROM latent
  UNION ALL
  SELECT {lead}, CASE v.col {dims} END, v.col, l.center
  FROM ({long(source, categorical, ids, 'level', 'VARCHAR')}) v
       JOIN levels l ON l.col = v.col AND l.level = v.level)"""


def wide(source: str, ids: str, width: int, value: str, name: str = "z") -> str:
    cells = ", ".join(
        f"{r4(f'max(CASE WHEN dim = {i} THEN {value} END)')} AS {name}{i}" for i in range(width)
    )
    return f"SELECT {ids}, {cells} FROM {source} GROUP BY {ids}"


def encoder_ctes(source: str, numeric: list[str], categorical: list[str], ids: str) -> str:
    return ", ".join(
        [
            grid_ctes(source, numeric),
            score_ctes(source, numeric, ids),
            levels_ctes(source, categorical),
            latents_cte(source, numeric, categorical, ids),
        ]
    )


def decode_ctes(source: str) -> str:
    """From ``source`` (c_custkey, dim, col, z) to ``num_back`` and ``cat_back``."""
    return f"""
lat_p AS (
  SELECT c_custkey, d.col, greatest(-4.5e0, least(4.5e0, d.z * t.scale + t.mean)) AS y_
  FROM {source} d JOIN stats t ON t.col = d.col),
lat_h AS (SELECT c_custkey, l.col, {normal_cdf_sql('y_')} * cells AS h, cells FROM lat_p l JOIN sized s ON s.col = l.col),
num_back AS MATERIALIZED (
  SELECT c_custkey, h.col,
         a.value + (b.value - a.value) * (h.h - floor(h.h)) AS exact
  FROM lat_h h JOIN refs a ON a.col = h.col AND a.j = CAST(floor(h.h) AS BIGINT)
       JOIN refs b ON b.col = h.col AND b.j = least(CAST(floor(h.h) AS BIGINT) + 1, h.cells)),
cat_back AS MATERIALIZED (
  SELECT c_custkey, col, level FROM (
    SELECT d.c_custkey, d.col, l.level,
           row_number() OVER (PARTITION BY d.c_custkey, d.col ORDER BY abs(d.z - l.center), l.center) AS rn
    FROM {source} d JOIN levels l ON l.col = d.col) WHERE rn = 1)"""


def hash_rank(ids: str, seed: str = "42") -> str:
    texts = [f"CAST({part.strip()} AS VARCHAR)" for part in [seed, *ids.split(",")]]
    sized = [f"coalesce(length({t}) || '.' || {t}, '~')" for t in texts]
    return f"md5(concat_ws(':', {', '.join(sized)}))"


def number(text: str) -> str:
    return f"CAST('0x' || substr({text}, 1, 13) AS BIGINT)"


def schedule_cte() -> str:
    level = lambda x: f"power(cos((({x}) / 1000e0 + 0.008e0) / 1.008e0 * pi() / 2), 2)"
    return f"""
sched_a AS (
  SELECT t, greatest(1e-6, least(0.999e0, 1 - {level('t + 1')} / {level('t')})) AS beta FROM range(1000) r(t)),
sched AS MATERIALIZED (
  SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM sched_a)"""


def noised_ctes() -> str:
    unit = f"({number(hash_rank('c_custkey, dim'))} + 0.5e0) / {HASH_RANGE}"
    step = f"{number(hash_rank(chr(34) + 'c_custkey' + chr(34) + ', ' + chr(39) + 't' + chr(39)))} % 1000"
    return f"""{schedule_cte()},
drawn AS (SELECT c_custkey, dim, z, {unit} AS u_, {step} AS t FROM latents),
{probit_cte('noisy', 'drawn', 'u_', 'noise')},
noised AS MATERIALIZED (
  SELECT c_custkey, dim, s.t, noise, sqrt(1 - alpha_bar) AS sqrt_omab,
         sqrt(alpha_bar) * z + sqrt(1 - alpha_bar) * noise AS x_t
  FROM noisy n JOIN sched s ON s.t = n.t)"""


def cells_ctes() -> str:
    """(c_custkey, dim, z): latents spread over level shares and tied references."""
    u = f"({number(hash_rank('v.c_custkey, v.col'))} + 0.5e0) / {HASH_RANGE}"
    dims = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate([*HH_NUMERIC, *HH_CATEGORICAL]))
    return f"""
cell_p AS (
  SELECT v.c_custkey, CASE v.col {dims} END AS dim,
         greatest(0.5e0 / 2000, least(1 - 0.5e0 / 2000,
           CASE WHEN v.value = g.value THEN g.p_min + {u} * (g.p_max - g.p_min)
                ELSE g.p_max + (v.value - g.value) / (g.next_value - g.value) * (g.next_p - g.p_max) END)) AS q_
  FROM vals v ASOF JOIN grid_next g ON v.col = g.col AND v.value >= g.value
  UNION ALL
  SELECT v.c_custkey, CASE v.col {dims} END, (l.below + {u} * l.n) / l.total
  FROM ({long('household', HH_CATEGORICAL, 'c_custkey', 'level', 'VARCHAR')}) v
       JOIN levels l ON l.col = v.col AND l.level = v.level),
{probit_cte('cell_z', 'cell_p', 'q_', 'raw')},
cell_latents AS MATERIALIZED (
  SELECT c_custkey, dim, greatest(-4.5e0, least(4.5e0, raw)) AS z FROM cell_z)"""


def marginal_ctes() -> str:
    """Independent draws by (row_id, dim) decoded through references and level shares."""
    u = f"({number(hash_rank('r.row_id, d.dim'))} + 0.5e0) / {HASH_RANGE}"
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate([*HH_NUMERIC, *HH_CATEGORICAL]))
    return f"""
draws AS MATERIALIZED (
  SELECT r.row_id, d.col, {u} AS u
  FROM range((SELECT count(*) FROM household)) r(row_id), (VALUES {names}) d(dim, col)),
draw_h AS (
  SELECT d.row_id, d.col, s.cells, greatest(3.3976731247300535e-06, least(1 - 3.3976731247300535e-06, u)) * s.cells AS h
  FROM draws d JOIN sized s ON s.col = d.col),
drawn_numbers AS (
  SELECT h.row_id, h.col, a.value + (b.value - a.value) * (h.h - floor(h.h)) AS exact
  FROM draw_h h JOIN refs a ON a.col = h.col AND a.j = CAST(floor(h.h) AS BIGINT)
       JOIN refs b ON b.col = h.col AND b.j = least(CAST(floor(h.h) AS BIGINT) + 1, h.cells)),
drawn_levels AS (
  SELECT d.row_id, d.col, l.level FROM draws d JOIN levels l
    ON l.col = d.col AND d.u >= l.below / CAST(l.total AS DOUBLE) AND d.u < (l.below + l.n) / CAST(l.total AS DOUBLE))"""


def ks_sql(source: str) -> str:
    return f"""
ks_counts AS (
  SELECT col, value, count(*) FILTER (side = 'real') AS r, count(*) FILTER (side = 'synth') AS s
  FROM ({long(source, LINE_NUMERIC, 'side')}) GROUP BY col, value),
ks_cum AS (
  SELECT col, sum(r) OVER w / sum(r) OVER (PARTITION BY col) AS fr,
         sum(s) OVER w / sum(s) OVER (PARTITION BY col) AS fs,
         sum(r) OVER (PARTITION BY col) AS n, sum(s) OVER (PARTITION BY col) AS m
  FROM ks_counts WINDOW w AS (PARTITION BY col ORDER BY value)),
ks AS MATERIALIZED (
  SELECT col, max(abs(fr - fs)) AS ks_stat, CAST(max(n) AS DOUBLE) AS n, CAST(max(m) AS DOUBLE) AS m
  FROM ks_cum GROUP BY col)"""


def tvd_sql(source: str) -> str:
    return f"""
tv_counts AS (
  SELECT col, level, count(*) FILTER (side = 'real') AS r, count(*) FILTER (side = 'synth') AS s
  FROM ({long(source, LINE_CATEGORICAL, 'side', 'level', 'VARCHAR')}) GROUP BY col, level),
tv_share AS (
  SELECT col, abs(r / sum(r) OVER (PARTITION BY col) - s / sum(s) OVER (PARTITION BY col)) AS gap FROM tv_counts),
tv AS MATERIALIZED (SELECT col, sum(gap) / 2 AS tvd FROM tv_share GROUP BY col)"""


def corr_sql(source: str, by_side: bool = True) -> str:
    parts = []
    for side in ("real", "synth") if by_side else ("",):
        where = f"WHERE side = '{side}'" if side else ""
        for a in LINE_NUMERIC:
            for b in LINE_NUMERIC:
                parts.append(
                    f"SELECT '{side}' AS side, '{a}' AS \"row\", '{b}' AS col, corr({a}, {b}) AS r FROM {source} {where}"
                )
    return f"cm AS MATERIALIZED ({' UNION ALL '.join(parts)})"


FROBENIUS = """
fro AS (SELECT sqrt(sum(power(a.r - b.r, 2))) AS f FROM cm a JOIN cm b ON a."row" = b."row" AND a.col = b.col
        WHERE a.side = 'real' AND b.side = 'synth')"""


def fidelity_sql(pair: str) -> str:
    return f"""WITH {pair}, {ks_sql('pair')}, {tvd_sql('pair')}, {corr_sql('pair')}, {FROBENIUS},
per AS (SELECT 'ks' AS metric, col AS "column", {r4('ks_stat')} AS value FROM ks
        UNION ALL SELECT 'tvd', col, {r4('tvd')} FROM tv)
SELECT 'ours' AS method, * FROM per
UNION ALL SELECT 'ours', 'avg_' || metric, '', round(avg(round(value * 10000))) / 10000 FROM per GROUP BY metric
UNION ALL SELECT 'ours', 'corr_frobenius', '', {r4('f')} FROM fro"""


def mixed_ctes() -> str:
    """(c_custkey, side, z0..z7) from the household table."""
    out = []
    dictionaries = f"""
od AS MATERIALIZED (
  SELECT col, level, row_number() OVER (PARTITION BY col ORDER BY level) - 1 AS idx
  FROM (SELECT DISTINCT col, level FROM ({long("(SELECT * FROM household WHERE side = 'real')", HH_CATEGORICAL, '', 'level', 'VARCHAR')})))"""
    codes = ", ".join(
        f"coalesce((SELECT idx FROM od WHERE od.col = '{c}' AND od.level = h.{c}), -1) AS o_{c}"
        for c in HH_CATEGORICAL
    )
    features = [*HH_NUMERIC, *[f"o_{c}" for c in HH_CATEGORICAL]]
    moments = ", ".join(
        f"avg({f}) AS m{i}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s{i}"
        for i, f in enumerate(features)
    )
    scaled = ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(features))
    out.append(dictionaries)
    out.append(f"coded AS MATERIALIZED (SELECT *, {codes} FROM household h)")
    out.append(f"moments AS MATERIALIZED (SELECT {moments} FROM coded WHERE side = 'real')")
    out.append(f"mixed AS MATERIALIZED (SELECT c_custkey AS id, side, {scaled} FROM coded, moments)")
    return ", ".join(out)


MIXED_DISTANCE = "sqrt(" + " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(8)) + ")"


def knn_cte(source: str, distance: str, k: int, where: str = "TRUE") -> str:
    return f"""
near AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.id, a.side, b.id AS neighbor, b.side AS other, {distance} AS dist,
           row_number() OVER (PARTITION BY a.id ORDER BY {distance}, b.id) AS rank
    FROM {source} a JOIN {source} b ON a.id <> b.id WHERE {where}) WHERE rank <= {k})"""


VECTORS = """
vec AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synth' END AS side,
         CAST(embedding AS DOUBLE[]) AS z FROM embeddings)"""
VECTOR_DISTANCE = "list_distance(a.z, b.z)"

SNN_CTES = """
votes AS (SELECT id, side, avg(CASE WHEN other <> side THEN 1e0 ELSE 0e0 END) AS f FROM near GROUP BY id, side),
snn_ AS (SELECT avg(f) FILTER (side = 'real') AS r, avg(f) FILTER (side = 'synth') AS s,
                count(*) FILTER (side = 'real') AS n_real, count(*) FILTER (side = 'synth') AS n_synth FROM votes)"""


def dcr_ctes() -> str:
    return f"""
s2r AS MATERIALIZED (SELECT a.id, min({MIXED_DISTANCE}) AS d FROM mixed a JOIN mixed b ON a.side = 'synth' AND b.side = 'real' GROUP BY a.id),
r2r AS MATERIALIZED (SELECT a.id, min({MIXED_DISTANCE}) AS d FROM mixed a JOIN mixed b
        ON a.side = 'real' AND b.side = 'real' AND a.id <> b.id GROUP BY a.id),
dcr_ AS (SELECT quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.05) AS fifth, avg(d) AS mean, count(*) AS n_synth,
                (SELECT quantile_cont(d, 0.5) FROM r2r) AS base, (SELECT count(*) FROM r2r) AS n_real FROM s2r)"""


SNN_COLUMNS = {
    "snn_real": "r", "snn_synth": "s", "snn_mean": "(r + s) / 2", "deviation": "abs((r + s) / 2 - 0.5e0)",
}
DCR_COLUMNS = {
    "dcr_synth_to_real_median": "med", "dcr_synth_to_real_5th": "fifth",
    "dcr_synth_to_real_mean": "mean", "dcr_real_to_real_median": "base", "dcr_ratio": "med / base",
}


def classification_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
cells AS (SELECT {lead}y, yhat, count(*) AS n FROM {source} GROUP BY {lead}y, yhat),
roles AS (SELECT {lead}y AS c, n AS actual, 0 AS predicted, CASE WHEN y = yhat THEN n ELSE 0 END AS hit FROM cells
          UNION ALL SELECT {lead}yhat, 0, n, 0 FROM cells),
classes AS (SELECT {lead}c, sum(actual) AS actual, sum(predicted) AS predicted, sum(hit) AS hit FROM roles GROUP BY {lead}c),
cls AS MATERIALIZED (SELECT {lead}CAST(sum(hit) AS DOUBLE) / sum(actual) AS accuracy,
                            avg(2e0 * hit / (actual + predicted)) AS macro_f1 FROM classes {group})"""


SCORED_MULTI = f"""{HOUSEHOLD},
multi AS MATERIALIZED (
  SELECT c_custkey, spend_quintile AS y, CAST(ntile(5) OVER (ORDER BY max_order, c_custkey) AS VARCHAR) AS yhat
  FROM household)"""


def _splits(source: str, ids: str, seeds) -> str:
    return " UNION ALL ".join(
        f"""SELECT *, {s} AS seed, CASE WHEN rk <= floor(n * 0.7e0) THEN 'train'
            WHEN rk <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY {hash_rank(ids, str(s))}) AS rk, count(*) OVER () AS n FROM {source})"""
        for s in seeds
    )


def oracle_sql() -> dict[str, str]:
    hh = f"WITH {HOUSEHOLD}"
    encoder = f"WITH {HOUSEHOLD}, {encoder_ctes('household', HH_NUMERIC, HH_CATEGORICAL, 'c_custkey')}"
    moved = "moved AS MATERIALIZED (SELECT c_custkey, dim, col, z * 0.9e0 + 0.03e0 AS z FROM latents)"
    line_id = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    sql = {}

    # profiles
    sql["completeness"] = f"WITH {HOUSEHOLD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing FROM household"
        for c in [*HH_NUMERIC, *HH_CATEGORICAL]
    )
    sql["numeric_bounds"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c}) AS minimum, max({c}) AS maximum FROM lineitem"
        for c in LINE_NUMERIC
    )
    sql["clip_columns"] = f"""WITH {SHIFTED},
b AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in LINE_NUMERIC)} FROM pair WHERE side = 'real')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {', '.join(f'greatest(lo_{c}, least(hi_{c}, {c})) AS {c}' for c in LINE_NUMERIC if c != 'l_extendedprice')},
       {r4('greatest(lo_l_extendedprice, least(hi_l_extendedprice, l_extendedprice))')} AS l_extendedprice
FROM pair, b WHERE side = 'synth'"""
    sql["category_freq"] = f"""SELECT col AS "column", level, count(*) AS n,
       {r4('count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE)')} AS freq
FROM ({long('lineitem', LINE_CATEGORICAL, '', 'level', 'VARCHAR')}) GROUP BY col, level"""
    sql["category_levels"] = f"""WITH {HOUSEHOLD}, {levels_ctes('household', HH_CATEGORICAL)}
SELECT col AS "column", level, n, idx, k, below, total, {r4('center')} AS center FROM levels"""
    sql["out_of_domain"] = f"""WITH {PAIR_ORDERS},
l AS (SELECT side, col, level FROM ({long('pair', ['o_custkey', 'o_orderpriority'], 'side', 'level', 'VARCHAR')}))
SELECT col AS "column", level, count(*) AS n FROM l WHERE side = 'synth'
  AND NOT EXISTS (SELECT 1 FROM l r WHERE r.side = 'real' AND r.col = l.col AND r.level = l.level)
GROUP BY col, level"""
    sql["head_n"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200"
    sql["train_summary"] = f"""WITH {HOUSEHOLD}
SELECT 'rows' AS measure, '' AS "column", count(*) AS value FROM household
UNION ALL SELECT 'columns', '', 8
UNION ALL SELECT 'levels', col, count(DISTINCT level) FROM ({long('household', HH_CATEGORICAL, '', 'level', 'VARCHAR')}) GROUP BY col"""
    sql["labelled_union"] = f"""WITH {PAIR_ORDERS}
SELECT side, o_orderstatus, count(*) AS n, {r4('avg(o_totalprice)', 2)} AS mean_price FROM pair GROUP BY side, o_orderstatus"""
    sql["quantile_grid"] = f"""WITH {LINES}, {grid_ctes('pair', LINE_NUMERIC)}
SELECT col AS "column", {r4('value')} AS value, {r4('p_min', 8)} AS p_min, {r4('p_max', 8)} AS p_max FROM grid"""
    sql["sketch_ranks"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_rows, true AS within FROM lineitem" for c in LINE_NUMERIC
    )
    sql["probit_column"] = f"""WITH ranks AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY {hash_rank('o_orderkey')}) AS rk, count(*) OVER () AS n FROM orders),
probs AS (SELECT o_orderkey, ({number(hash_rank('o_orderkey'))} + 0.5e0) / {HASH_RANGE} AS p FROM ranks),
{probit_cte('zs', 'probs', 'p', 'z')}
SELECT o_orderkey, {r4('z', 6)} AS z FROM zs"""

    # features
    sql["one_hot"] = f"WITH {HOUSEHOLD} SELECT c_custkey, " + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}={v}\""
        for c, vs in {
            "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
            "r_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
            "spend_quintile": ["1", "2", "3", "4", "5"],
        }.items()
        for v in vs
    ) + " FROM household"
    sql["label_encode"] = """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders"""
    sql["ordinal_encode"] = f"""WITH {PAIR_ORDERS},
d AS (SELECT lv, row_number() OVER (ORDER BY lv) - 1 AS idx FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS lv FROM pair WHERE side = 'real')),
e AS (SELECT o_orderpriority AS lv, row_number() OVER (ORDER BY o_orderpriority) - 1 AS idx
      FROM (SELECT DISTINCT o_orderpriority FROM pair WHERE side = 'real'))
SELECT o_orderkey, side, coalesce(d.idx, -1) AS o_custkey, coalesce(e.idx, -1) AS o_orderpriority
FROM pair LEFT JOIN d ON d.lv = CAST(o_custkey AS VARCHAR) LEFT JOIN e ON e.lv = o_orderpriority"""
    sql["zscore"] = f"""WITH {LINES},
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE_NUMERIC)} FROM pair WHERE side = 'real')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side,
       {', '.join(f"{r4(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in LINE_NUMERIC)} FROM pair, m"""
    sql["encode_mixed"] = f"""WITH {HOUSEHOLD}, {mixed_ctes()}
SELECT id AS c_custkey, side, {', '.join(f"{r4(f'z{i}')} AS z{i}" for i in range(8))} FROM mixed"""

    # fidelity
    for name, pair in (("", LINES), ("_shifted", SHIFTED)):
        series = "2 * sum(power(-1e0, k - 1) * exp(-2e0 * k * k * ks_stat * ks_stat * n * m / (n + m)))"
        sql[f"ks_two_sample{name}"] = f"""WITH {pair}, {ks_sql('pair')}
SELECT col AS "column", {r4('max(ks_stat)')} AS ks_stat,
       CASE WHEN max(ks_stat) * sqrt(max(n) * max(m) / (max(n) + max(m))) < 0.2 THEN 1e0
            ELSE {r4(f'greatest(0, least(1, {series}))', 6)} END AS p_value
FROM ks, range(1, 101) t(k) GROUP BY col"""
        sql[f"tvd{name}"] = f"""WITH {pair}, {tvd_sql('pair')} SELECT col AS "column", {r4('tvd')} AS tvd FROM tv"""
        sql[f"corr_frobenius{name}"] = f"""WITH {pair}, {corr_sql('pair')}, {FROBENIUS}
SELECT {r4('f')} AS corr_frobenius FROM fro"""
        sql[f"fidelity_summary{name}"] = fidelity_sql(pair)
    sql["corr_matrix"] = f"""WITH {corr_sql('lineitem', False)} SELECT "row", col, {r4('r')} AS r FROM cm"""

    # sampling
    sql["sample_exact"] = f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_rank('o_orderkey')} LIMIT 5000"""
    sql["split_train_val_test"] = f"SELECT o_orderkey, split FROM ({_splits('orders', 'o_orderkey', [42])})"
    sql["split_by_seed"] = f"SELECT o_orderkey, seed, split FROM ({_splits('orders', 'o_orderkey', SEEDS)})"
    sql["split_stratified"] = f"""SELECT o_orderkey, o_orderpriority,
  CASE WHEN rk <= ceil(n * 0.3e0) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_rank('o_orderkey')}) AS rk,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""
    sql["balanced_pair"] = f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'real' ELSE 'synth' END AS side FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {hash_rank('o_orderkey')}) AS rk FROM p)
SELECT o_orderkey, side FROM r WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM p GROUP BY side))"""

    # scores
    sql["classification_metrics"] = f"""WITH {SCORED_MULTI}, {classification_sql('multi')}
SELECT {r4('accuracy')} AS accuracy, {r4('macro_f1')} AS macro_f1 FROM cls"""
    sql["seed_summary"] = f"""WITH {SCORED_MULTI},
tested AS (SELECT * FROM ({_splits('multi', 'c_custkey', SEEDS)}) WHERE split = 'test'),
{classification_sql('tested', 'seed')},
flat AS (SELECT 'accuracy' AS metric, accuracy AS value FROM cls UNION ALL SELECT 'macro_f1', macro_f1 FROM cls)
SELECT 'ours' AS method, metric, {r4('avg(value)')} AS mean, {r4('stddev_pop(value)')} AS std FROM flat GROUP BY metric"""
    sql["roc_auc"] = f"""WITH s AS (SELECT quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM s),
a AS (SELECT sum(rk) FILTER (y = 1) AS w, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r)
SELECT {r4('(w - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * q)')} AS auc FROM a"""
    sql["binary_metrics"] = f"""WITH s AS MATERIALIZED (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
scored AS MATERIALIZED (SELECT y, CASE WHEN score > (SELECT quantile_cont(score, 0.5) FROM s) THEN 1 ELSE 0 END AS yhat FROM s),
{classification_sql('scored')}
SELECT {r4('accuracy')} AS accuracy, {r4('macro_f1')} AS macro_f1 FROM cls"""
    sql["regression_metrics"] = f"""WITH s AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders),
m AS (SELECT avg((y - p) * (y - p)) AS mse, var_pop(y) AS v FROM s)
SELECT {r4('sqrt(mse)', 2)} AS rmse, {r4('1 - mse / v')} AS r2 FROM m"""

    # encoder
    sql["encoder_state"] = f"""{encoder}
SELECT col AS "column", {r4('mean')} AS mean, {r4('scale')} AS scale, {r4('minimum', 2)} AS minimum, {r4('maximum', 2)} AS maximum FROM stats"""
    sql["encode_numeric"] = encoder + wide(
        "latents WHERE dim < 5", "c_custkey", 5, "z"
    )
    sql["encode_categorical"] = f"""{encoder}
SELECT c_custkey, {', '.join(f"{r4(f'max(CASE WHEN dim = {5 + i} THEN z END)')} AS {c}" for i, c in enumerate(HH_CATEGORICAL))}
FROM latents GROUP BY c_custkey"""
    sql["encode_rows"] = (
        f"WITH {LINES}, {encoder_ctes('pair', LINE_NUMERIC, LINE_CATEGORICAL, line_id)}, "
        # the price identifies a line and is also a value, so the long rows name it twice
        + wide("latents", line_id, 6, "z").join(["out_ AS (", ")"])
        + f"SELECT {line_id}, {', '.join(f'z{i}' for i in range(6))} FROM out_"
    )
    sql["encode_rows_household"] = encoder + wide("latents", "c_custkey", 8, "z")
    numbers = ", ".join(
        f"CAST(round_even(max(CASE WHEN col = '{c}' THEN exact END), 0) AS BIGINT) AS {c}" for c in HH_NUMERIC
    )
    texts = ", ".join(f"max(CASE WHEN col = '{c}' THEN level END) AS {c}" for c in HH_CATEGORICAL)
    sql["decode_numeric"] = f"{encoder}, {moved}, {decode_ctes('moved')} SELECT c_custkey, {numbers} FROM num_back GROUP BY c_custkey"
    sql["decode_categorical"] = f"{encoder}, {moved}, {decode_ctes('moved')} SELECT c_custkey, {texts} FROM cat_back GROUP BY c_custkey"
    sql["decode_rows"] = f"""{encoder}, {moved}, {decode_ctes('moved')},
a AS (SELECT c_custkey, {numbers} FROM num_back GROUP BY c_custkey), b AS (SELECT c_custkey, {texts} FROM cat_back GROUP BY c_custkey)
SELECT a.*, {', '.join(f'b.{c}' for c in HH_CATEGORICAL)} FROM a JOIN b USING (c_custkey)"""
    sql["roundtrip_error"] = f"""{encoder}, {decode_ctes('latents')},
num_err AS (SELECT n.col, abs(round_even(n.exact, 0) - v.value) AS e FROM num_back n JOIN vals v ON v.col = n.col AND v.c_custkey = n.c_custkey),
cat_err AS (SELECT n.col, n.level <> v.level AS e FROM cat_back n
            JOIN ({long('household', HH_CATEGORICAL, 'c_custkey', 'level', 'VARCHAR')}) v ON v.col = n.col AND v.c_custkey = n.c_custkey)
SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (e > 0.5) AS n_changed, {r4('max(e)', 2)} AS max_error FROM num_err GROUP BY col
UNION ALL SELECT col, count(*), count(*) FILTER (e), NULL FROM cat_err GROUP BY col"""

    sql["encode_cells"] = f"{encoder}, {cells_ctes()} " + wide("cell_latents", "c_custkey", 8, "z")
    sql["generator_moments"] = f"""{encoder}, {cells_ctes()}
SELECT a.dim AS i, b.dim AS j, {r4('avg(a.z)')} AS mean,
       {r4('covar_samp(a.z, b.z) + CASE WHEN a.dim = b.dim THEN 1e-6 ELSE 0 END')} AS covariance
FROM cell_latents a JOIN cell_latents b USING (c_custkey) GROUP BY a.dim, b.dim"""
    weighted = "sum(n_orders * {}) / sum(n_orders)"
    sql["generator_moments_weighted"] = f"""{encoder}, {cells_ctes()},
wl AS (SELECT c_custkey, dim, z, n_orders FROM cell_latents JOIN household USING (c_custkey)),
wm AS (SELECT dim, {weighted.format('z')} AS m FROM wl GROUP BY dim)
SELECT a.dim AS i, b.dim AS j, {r4('any_value(ma.m)')} AS mean,
       {r4('sum(a.n_orders * (a.z - ma.m) * (b.z - mb.m)) / (sum(a.n_orders) - 1) + CASE WHEN a.dim = b.dim THEN 1e-6 ELSE 0 END')} AS covariance
FROM wl a JOIN wl b USING (c_custkey) JOIN wm ma ON ma.dim = a.dim JOIN wm mb ON mb.dim = b.dim GROUP BY a.dim, b.dim"""
    sql["baseline_marginals"] = f"""{encoder}, {marginal_ctes()},
a AS (SELECT row_id, {numbers} FROM drawn_numbers GROUP BY row_id), b AS (SELECT row_id, {texts} FROM drawn_levels GROUP BY row_id)
SELECT a.*, {', '.join(f'b.{c}' for c in HH_CATEGORICAL)} FROM a JOIN b USING (row_id)"""

    # diffusion
    step = f"{number(hash_rank('o_orderkey, ' + chr(39) + 't' + chr(39)))} % 1000"
    sql["random_step"] = f"SELECT o_orderkey, {step} AS t FROM orders"
    sql["noise_schedule"] = f"""WITH {schedule_cte()}, s AS (SELECT {step} AS t, count(*) AS n FROM orders GROUP BY 1)
SELECT sched.t, coalesce(s.n, 0) AS n, {r4('beta', 8)} AS beta, {r4('alpha', 8)} AS alpha, {r4('alpha_bar', 8)} AS alpha_bar,
       {r4('sqrt(alpha_bar)', 8)} AS sqrt_ab, {r4('sqrt(1 - alpha_bar)', 8)} AS sqrt_omab
FROM sched LEFT JOIN s ON s.t = sched.t"""
    sql["forward_noise"] = f"{encoder}, {noised_ctes()} " + wide("noised", "c_custkey, t", 8, "x_t", "x")
    sql["denoise_loss"] = f"""{encoder}, {noised_ctes()},
per AS (SELECT c_custkey, avg(power(noise - sqrt_omab * x_t, 2)) AS l FROM noised GROUP BY c_custkey)
SELECT {r4('avg(l)')} AS loss, {r4('avg(l * n_orders)')} AS weighted_loss FROM per JOIN household USING (c_custkey)"""

    # reports
    sql["check_synthetic"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, 0 AS n_missing, 0 AS n_out_of_domain FROM customer"""
        for c in (*HH_NUMERIC, *HH_CATEGORICAL)
    )
    sql["compare_views"] = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{name}' AS method, {', '.join(
            f"max(value) FILTER (metric = '{m}') AS {m}, CAST(NULL AS DOUBLE) AS {m}_std"
            for m in ('avg_ks', 'avg_tvd', 'corr_frobenius'))}
        FROM ({fidelity_sql(pair)}) WHERE "column" = '')"""
        for name, pair in (("halves", LINES), ("shifted", SHIFTED))
    )
    # the record writes a number below a thousandth as 5.0E-4
    number_text = """CASE WHEN value > 0 AND value < 1e-3 THEN CAST(CAST(round(value * 1e4) AS INT) AS VARCHAR) || '.0E-4'
                     ELSE CAST(value AS VARCHAR) END"""
    field = lambda name, value: f"""'"{name}":"' || {value} || '"'"""
    sql["report_json"] = f"""SELECT method, '{{"method":"' || method || '","metrics":[' || string_agg(
  '{{"family":"fidelity",' || {field('metric', 'metric')} || ',' || {field('column', '"column"')} || ',"mean":' || {number_text} || '}}',
  ',' ORDER BY metric, "column") || ']}}' AS record FROM ({fidelity_sql(SHIFTED)}) GROUP BY method"""
    sql["report_rows"] = f"""SELECT method, 'fidelity' AS family, metric, "column", value AS mean FROM ({fidelity_sql(SHIFTED)})"""

    # neighbours
    sql["knn_pooled"] = f"""WITH {VECTORS}, {knn_cte('vec', VECTOR_DISTANCE, 5)}
SELECT id AS vec_id, rank, neighbor, {r4('dist')} AS dist, side = other AS same_side FROM near"""
    sql["dcr_nearest"] = f"""WITH {VECTORS}, {knn_cte('vec', VECTOR_DISTANCE, 1, "a.side = 'synth' AND b.side = 'real'")}
SELECT id AS vec_id, neighbor, {r4('dist')} AS dist FROM near"""
    sql["dcr_leave_one_out"] = f"""WITH {VECTORS}, {knn_cte('vec', VECTOR_DISTANCE, 1, "a.side = 'real' AND b.side = 'real'")}
SELECT id AS vec_id, neighbor, {r4('dist')} AS dist FROM near"""
    shared = VECTORS.strip().rstrip(",")
    sql["knn_shared_ids"] = f"""WITH {shared}, {knn_cte('vec', VECTOR_DISTANCE, 5)}
SELECT id // 2 AS vec_id, side, rank, neighbor // 2 AS neighbor, {r4('dist')} AS dist, side = other AS same_side FROM near"""
    sql["row_id"] = f"""SELECT row_number() OVER (ORDER BY {hash_rank('o_orderstatus, o_orderpriority', '0')}) - 1 AS row_id,
  o_orderstatus, o_orderpriority FROM orders"""
    sql["zscore_nan"] = f"""WITH v AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS q FROM lineitem),
m AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM v)
SELECT l_orderkey, l_linenumber, {r4('(q - m) / s')} AS l_quantity FROM v, m"""
    sql["split_stratified_null"] = f"""WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_rank('o_orderkey')}) AS rk, count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT o_orderkey, label, CASE WHEN rk <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r"""
    sql["split_stratified_total"] = f"""WITH o AS (SELECT o_orderkey,
  CASE WHEN o_orderkey = 7 THEN 'single' ELSE nullif(o_orderpriority, '5-LOW') END AS label FROM orders),
l AS (SELECT label, count(*) AS n, floor(count(*) * 0.3e0) AS base, count(*) * 0.3e0 - floor(count(*) * 0.3e0) AS rest FROM o GROUP BY label),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label NULLS FIRST)
  <= ceil(sum(n) OVER () * 0.3e0) - sum(base) OVER () THEN 1 ELSE 0 END AS wanted FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_rank('o_orderkey')}) AS rk FROM o)
SELECT o_orderkey, r.label, CASE WHEN rk <= wanted THEN 'test' ELSE 'train' END AS split
FROM r JOIN q ON r.label IS NOT DISTINCT FROM q.label"""
    for name, columns, seed, many in (
        ("baseline_resampled", [*HH_NUMERIC, "c_mktsegment", "r_name"], "42", "count(*)"),
        ("baseline_resampled_more", ["c_acctbal", "spend", "r_name"], "7", "count(*) * 5 // 2"),
    ):
        ranked = ", ".join(
            f"row_number() OVER (ORDER BY {hash_rank(f'c_custkey, {chr(39)}{c}{chr(39)}', seed)}) - 1 AS r_{c}" for c in columns
        )
        kept = ", ".join(
            f"{c}.{c}" if c in ("c_mktsegment", "r_name") else f"CAST({c}.{c} AS DOUBLE) AS {c}" for c in columns
        )
        joins = " ".join(f"JOIN ranked {c} ON {c}.r_{c} = row_id * total // many" for c in columns)
        sql[name] = f"""WITH {HOUSEHOLD}, ranked AS MATERIALIZED (SELECT *, {ranked} FROM household),
s AS (SELECT count(*) AS total, {many} AS many FROM household),
i AS (SELECT unnest(range(many)) AS row_id, total, many FROM s)
SELECT row_id, {kept} FROM i {joins}"""
    sql["ks_exact"] = f"""WITH RECURSIVE
c AS (SELECT 'c_acctbal' AS col, CAST(c_acctbal AS DOUBLE) AS v, c_nationkey = 0 AS one FROM customer WHERE c_nationkey < 2
  UNION ALL SELECT 'c_custkey', CAST(c_custkey AS DOUBLE), c_nationkey = 0 FROM customer WHERE c_nationkey < 2),
u AS (SELECT col, v, sum(CAST(one AS BIGINT)) AS a, sum(CAST(NOT one AS BIGINT)) AS b FROM c GROUP BY col, v),
w AS (SELECT col, sum(a) OVER (PARTITION BY col ORDER BY v) AS ca, sum(b) OVER (PARTITION BY col ORDER BY v) AS cb,
        sum(a) OVER (PARTITION BY col) AS n, sum(b) OVER (PARTITION BY col) AS m FROM u),
d AS (SELECT col, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(max(abs(ca * m - cb * n)) AS BIGINT) AS k FROM w GROUP BY col, n, m),
path AS (
  SELECT col, n, m, k, 0::BIGINT AS step, 0::BIGINT AS i, 1e0 AS p FROM d
  UNION ALL
  SELECT col, n, m, k, step + 1, i + more, sum(p * CASE WHEN more = 1 THEN n - i ELSE m - (step - i) END / (n + m - step))
  FROM path, (VALUES (0::BIGINT), (1::BIGINT)) t(more)
  WHERE step < n + m AND CASE WHEN more = 1 THEN i < n ELSE step - i < m END
    AND abs((i + more) * m - (step + 1 - i - more) * n) < k
  GROUP BY col, n, m, k, step, i + more)
SELECT d.col AS "column", {r4('d.k / (d.n::DOUBLE * d.m)')} AS ks_stat,
  {r4('least(1e0, greatest(0e0, 1 - coalesce(p, 0)))', 6)} AS p_value
FROM d LEFT JOIN path ON path.col = d.col AND path.step = d.n + d.m"""
    mixed = f"WITH {HOUSEHOLD}, {mixed_ctes()}"
    snn = f"{knn_cte('mixed', MIXED_DISTANCE, 5)}, {SNN_CTES}"
    sql["snn"] = f"""{mixed}, {snn}
SELECT {', '.join(f'{r4(v)} AS {k}' for k, v in SNN_COLUMNS.items())}, 5 AS k, n_real, n_synth FROM snn_"""
    sql["dcr"] = f"""{mixed}, {dcr_ctes()}
SELECT {', '.join(f'{r4(v)} AS {k}' for k, v in DCR_COLUMNS.items())}, n_real, n_synth FROM dcr_"""
    entries = [("snn", k, v, "snn_") for k, v in {**SNN_COLUMNS, "k": "5e0", "n_real": "n_real", "n_synth": "n_synth"}.items()]
    entries += [("dcr", k, v, "dcr_") for k, v in {**DCR_COLUMNS, "n_real": "n_real", "n_synth": "n_synth"}.items()]
    sql["inter_record"] = f"{mixed}, {snn}, {dcr_ctes()} " + " UNION ALL ".join(
        f"SELECT '{f}' AS family, '{k}' AS metric, {r4(f'CAST({v} AS DOUBLE)')} AS value FROM {src}"
        for f, k, v, src in entries
    )
    return {name: " ".join(text.split("\n")) for name, text in sql.items()}
