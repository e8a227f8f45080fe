"""Independent SQL formulations (DuckDB dialect) of the registered queries.

Written from the definitions, not from the Spark code: the calibration view
uses decimal arithmetic, the GLR its closed form (standardised ridge normal
equations of two features), the depth-1 tree an exhaustive search over the
midpoints of adjacent distinct values, gradient descent a recursive CTE.
"""

from __future__ import annotations

from .rounding import DIGITS, rnd_sql

CAL = """
l AS (
  SELECT l_orderkey,
         sum(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2)))
             * (1 + cast(l_tax AS decimal(4,2)))) AS p,
         count(*) AS n_lines, sum(cast(l_quantity AS decimal(6,0))) AS qty
  FROM lineitem GROUP BY l_orderkey),
cal AS (
  SELECT o_orderkey AS row_id, o_totalprice AS observed, cast(p AS double) AS predicted,
         cast(year(o_orderdate) AS int) AS yr, cast(month(o_orderdate) AS int) AS mon,
         cast(day(o_orderdate) AS int) AS dom, cast(n_lines AS bigint) AS n_lines,
         cast(qty AS double) AS qty
  FROM orders JOIN l ON l_orderkey = o_orderkey),
d AS (SELECT *, observed - predicted AS delta_e FROM cal)"""

BUCKET = "cast(cast(concat('0x', substr(md5(cast(row_id AS varchar)), 1, 8)) AS bigint) % 100 AS int)"


def metric_aggs(sim: str, obs: str, p: str) -> str:
    both = f"({sim} IS NOT NULL AND {obs} IS NOT NULL)"
    s = f"(CASE WHEN {both} THEN {sim} END)"
    o = f"(CASE WHEN {both} THEN {obs} END)"
    sq = f"(({sim}) - ({obs})) * (({sim}) - ({obs}))"
    return ",\n       ".join([
        f"avg({sq}) AS {p}mse",
        f"sum({s} - {o}) AS {p}sd",
        f"sum({o}) AS {p}so",
        f"covar_pop({s}, {o}) AS {p}cov",
        f"stddev_pop({s}) * stddev_pop({o}) AS {p}sdp",
        f"sum({sq}) AS {p}sse",
        f"var_pop({o}) * count({o}) AS {p}sst",
    ])


def metric_final(p: str) -> str:
    r = f"({p}cov / nullif({p}sdp, 0))"
    return ", ".join([
        f"{rnd_sql(f'sqrt({p}mse)', DIGITS['rmse'])} AS rmse",
        f"{rnd_sql(f'100.0 * ({p}sd / nullif({p}so, 0))', DIGITS['pbias'])} AS pbias",
        f"{rnd_sql(f'{r} * {r}', DIGITS['cd'])} AS cd",
        f"{rnd_sql(f'1.0 - {p}sse / nullif({p}sst, 0)', DIGITS['nse'])} AS nse",
    ])


def three_way(scored_cte: str) -> str:
    """Report rows over a CTE with predicted, observed, improved, e_hat, delta_e."""
    return f"""agg AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')},
       {metric_aggs('improved', 'observed', 'i_')},
       {metric_aggs('e_hat', 'delta_e', 'd_')}
  FROM {scored_cte})
SELECT 'original' AS series, {metric_final('o_')} FROM agg
UNION ALL SELECT 'improved' AS series, {metric_final('i_')} FROM agg
UNION ALL SELECT 'delta_error' AS series, {metric_final('d_')} FROM agg"""


# Two-feature GLR (gaussian, identity, regParam 0.3) in closed form.
GLR = """
s AS (SELECT avg(delta_e) my, avg(qty) m1, avg(n_lines) m2, stddev_pop(delta_e) sy,
             stddev_pop(qty) s1, stddev_pop(n_lines) s2, corr(delta_e, qty) r1,
             corr(delta_e, n_lines) r2, corr(qty, n_lines) rho,
             0.3 / stddev_pop(delta_e) k FROM d),
b AS (SELECT *, ((1 + k) * r1 - rho * r2) / ((1 + k) * (1 + k) - rho * rho) * sy / s1 AS b1,
                ((1 + k) * r2 - rho * r1) / ((1 + k) * (1 + k) - rho * rho) * sy / s2 AS b2
      FROM s),
c AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b),
sc AS (SELECT d.*, (SELECT b0 FROM c) + (SELECT b1 FROM c) * qty + (SELECT b2 FROM c) * n_lines
                   AS e_hat FROM d),
sc2 AS (SELECT *, predicted + e_hat AS improved FROM sc)"""

# Depth-1 regression tree of delta_e on n_lines, trained on the hash-train rows.
STUMP = f"""
tr AS (SELECT n_lines AS x, delta_e AS y FROM d WHERE {BUCKET} < 70),
g AS (SELECT x, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM tr GROUP BY x),
tot AS (SELECT sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy FROM g),
cum AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx,
               sum(n) OVER (ORDER BY x) AS nl, sum(sy) OVER (ORDER BY x) AS syl,
               sum(syy) OVER (ORDER BY x) AS syyl FROM g),
cand AS (SELECT (x + nx) / 2.0 AS threshold, nl, syl, syyl,
                (SELECT n FROM tot) - nl AS nr, (SELECT sy FROM tot) - syl AS syr,
                (SELECT syy FROM tot) - syyl AS syyr
         FROM cum WHERE nx IS NOT NULL),
best AS (SELECT threshold, nl, nr, syl / nl AS left_mean, syr / nr AS right_mean
         FROM cand ORDER BY (syyl - syl * syl / nl) + (syyr - syr * syr / nr) LIMIT 1),
sc AS (SELECT d.*, CASE WHEN n_lines <= (SELECT threshold FROM best)
                        THEN (SELECT left_mean FROM best)
                        ELSE (SELECT right_mean FROM best) END AS e_hat FROM d),
sc2 AS (SELECT *, predicted + e_hat AS improved FROM sc)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


SQL: dict[str, str] = {}

SQL["calibration_view"] = _with(CAL) + "\nSELECT row_id, observed, predicted, yr, mon, dom, n_lines, qty FROM cal"

SQL["delta_table"] = _with(CAL) + "\nSELECT row_id, delta_e, yr, mon, dom, n_lines, qty FROM d"

SQL["pairs"] = _with(CAL) + "\nSELECT row_id, predicted, observed FROM cal"

SQL["original_metrics"] = _with(CAL, f"""agg AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')},
         count(*) AS n_rows, avg(observed) AS mo, avg(predicted) AS mp, sum(observed) AS so
  FROM cal)""") + f"""
SELECT {metric_final('o_')}, n_rows, {rnd_sql('mo', 4)} AS mean_observed,
       {rnd_sql('mp', 4)} AS mean_predicted, {rnd_sql('so', 0)} AS sum_observed FROM agg"""

SQL["glr_report"] = _with(CAL, GLR, three_way("sc2"))

SQL["glr_coefficients"] = _with(CAL, GLR) + f"""
SELECT 'qty' AS feature, {rnd_sql('b1', 6)} AS coefficient FROM c
UNION ALL SELECT 'n_lines', {rnd_sql('b2', 6)} FROM c
UNION ALL SELECT '(intercept)', {rnd_sql('b0', 6)} FROM c"""

SQL["glr_residuals"] = _with(CAL, GLR) + f"""
SELECT row_id, {rnd_sql('delta_e', 2)} AS label, {rnd_sql('e_hat', 2)} AS prediction,
       {rnd_sql('delta_e - e_hat', 2)} AS residual
FROM sc ORDER BY row_id LIMIT 20"""

SQL["hash_split"] = _with(CAL) + f"""
SELECT row_id, {BUCKET} AS bucket, {BUCKET} < 70 AS is_train FROM cal"""

_LINE = """li AS (
  SELECT coalesce(l_discount, 0.0) AS f0, coalesce(l_tax, 0.0) AS f1,
         coalesce(cast(ascii(l_returnflag) AS double), 0.0) AS f2,
         coalesce(cast(ascii(l_linestatus) AS double), 0.0) AS f3,
         coalesce(l_quantity, 0.0) AS f4
  FROM lineitem),
nd AS (SELECT count(DISTINCT f0) n0, count(DISTINCT f1) n1, count(DISTINCT f2) n2,
              count(DISTINCT f3) n3, count(DISTINCT f4) n4 FROM li)"""
SQL["categorical_features"] = _with(_LINE) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS feature, cast({i} AS int) AS position, n{i} <= 4 AS is_categorical, "
    f"cast(CASE WHEN n{i} <= 4 THEN n{i} END AS int) AS n_categories FROM nd"
    for i, name in enumerate(["l_discount", "l_tax", "returnflag_code", "linestatus_code",
                              "l_quantity"]))

SQL["stump_split"] = _with(CAL, STUMP) + f"""
SELECT 'n_lines' AS feature, threshold, {rnd_sql('left_mean', 4)} AS left_mean,
       {rnd_sql('right_mean', 4)} AS right_mean, cast(nl AS bigint) AS n_left,
       cast(nr AS bigint) AS n_right,
       (SELECT {rnd_sql('sqrt(avg((e_hat - delta_e) * (e_hat - delta_e)))', 4)}
          FROM sc WHERE {BUCKET} >= 70) AS holdout_rmse
FROM best"""

SQL["stump_report"] = _with(CAL, STUMP, three_way("sc2"))

SQL["preview"] = _with(CAL, STUMP) + f"""
SELECT row_id, {rnd_sql('e_hat', 4)} AS prediction, delta_e AS label,
       {rnd_sql('improved', 4)} AS improved
FROM sc2 ORDER BY row_id LIMIT 20"""

SQL["first_row"] = _with(CAL) + """
SELECT row_id, observed, predicted, yr, mon, dom, n_lines, qty FROM cal ORDER BY row_id LIMIT 1"""

SQL["label_lookup"] = _with(CAL, STUMP) + f"""
SELECT cast(json_object('row_id', row_id, 'prediction', {rnd_sql('e_hat', 2)}) AS varchar) AS json
FROM sc WHERE n_lines = 4 ORDER BY row_id LIMIT 1"""

SQL["chart_series"] = _with(CAL, STUMP) + f"""
SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, row_id, predicted AS original,
       {rnd_sql('improved', 4)} AS improved, observed
FROM sc2"""

SQL["event_index"] = """
SELECT event_id, user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
FROM events"""

SQL["sgd_one_feature"] = _with(CAL, """g AS (SELECT avg(qty * qty) AS gxx, avg(qty * delta_e) AS gxy FROM d),
r AS (
  WITH RECURSIVE it(t, w, done) AS (
    SELECT 0, CAST(0.0 AS double), false
    UNION ALL
    SELECT t + 1, nw,
           (t + 1 >= 2) AND abs(nw - w) < 0.001 * greatest(abs(nw), 1.0)
    FROM (SELECT t, w, done,
                 w - (CAST(1e-8 AS double) / sqrt(t + 1))
                     * ((SELECT gxx FROM g) * w - (SELECT gxy FROM g)) AS nw
          FROM it WHERE t < 100 AND NOT done) q
  )
  SELECT t, w FROM it ORDER BY t DESC LIMIT 1)""") + f"""
SELECT (round((SELECT w FROM r), 12) + 0.0) AS weight, cast((SELECT t FROM r) AS int) AS iterations,
       {rnd_sql('avg(((SELECT w FROM r) * qty - delta_e) * ((SELECT w FROM r) * qty - delta_e))', DIGITS['mse'])}
         AS training_mse
FROM d"""

_EV = """ev AS (
  SELECT event_id, cast(hour(ts) AS int) AS hour, cast(day(ts) AS int) AS day,
         cast(minute(ts) AS int) AS minute, cast(round(value * 100) AS bigint) AS cents
  FROM events)"""
_ITEMS = ("CASE WHEN day <> 0 THEN '1:' || cast(day AS varchar) END, "
          "CASE WHEN minute <> 0 THEN '2:' || cast(minute AS varchar) END, "
          "CASE WHEN cents <> 0 THEN '3:' || cast(cents AS varchar) END")
SQL["libsvm_lines"] = _with(_EV) + f"""
SELECT event_id,
       concat_ws(' ', CASE WHEN hour = 0 THEN '0' ELSE cast(hour AS varchar) END, {_ITEMS}) AS line,
       concat_ws(' ', '1', {_ITEMS}) AS line_unlabelled
FROM ev"""

_SERIES = """s AS (
  SELECT vec_id, cast(generate_subscripts(embedding, 1) - 1 AS int) AS time,
         cast(unnest(embedding) AS double) AS v
  FROM embeddings)"""
SQL["series_rows"] = _with(_SERIES) + """
SELECT vec_id, time, v * CAST(0.9 AS double) AS predicted, v AS observed FROM s"""

SQL["series_csv"] = _with(_SERIES) + """
SELECT vec_id, time, v * CAST(0.9 AS double) AS predicted, v AS observed,
       v - v * CAST(0.9 AS double) AS delta FROM s"""

SQL["prediction_list"] = _with(_SERIES) + """
SELECT vec_id, time AS pos, cast(cast(round(v * CAST(1e6 AS double)) AS bigint) AS double) AS value
FROM s"""

SQL["alignment"] = """
WITH t AS (SELECT o_orderkey AS k, 1 AS l, 0 AS r FROM orders
           UNION ALL SELECT l_orderkey AS k, 0 AS l, 1 AS r FROM lineitem),
p AS (SELECT k, sum(l) AS l, sum(r) AS r FROM t GROUP BY k)
SELECT cast(coalesce(sum(l), 0) AS bigint) AS n_left, cast(coalesce(sum(r), 0) AS bigint) AS n_right,
       count(CASE WHEN l > 0 AND r > 0 THEN 1 END) AS n_matched_keys,
       count(CASE WHEN r = 0 THEN 1 END) AS n_left_only,
       count(CASE WHEN l = 0 THEN 1 END) AS n_right_only,
       count(CASE WHEN l > 1 OR r > 1 THEN 1 END) AS n_duplicate_keys
FROM p"""


def _sgd_full() -> str:
    """Five-feature gradient descent (no intercept, step 1e-8 / sqrt(t), 100
    iterations, tolerance 0.001) as a recursive CTE over the weight vector,
    then the correction and the one-pass report of the ``sgd`` technique."""
    f = ["yr", "mon", "dom", "n_lines", "qty"]
    n = len(f)
    gram = ",\n       ".join(
        [f"avg(cast({f[i]} AS double) * cast({f[j]} AS double)) AS g{i}{j}"
         for i in range(n) for j in range(n)]
        + [f"avg(cast({f[i]} AS double) * delta_e) AS b{i}" for i in range(n)])
    w0 = ", ".join(["CAST(0.0 AS double)"] * n)
    ws = ", ".join(f"w{i}" for i in range(n))
    nws = ", ".join(f"nw{i}" for i in range(n))
    upd = ",\n                 ".join(
        f"w{i} - (CAST(1e-8 AS double) / sqrt(t + 1)) * ("
        + " + ".join(f"(SELECT g{i}{j} FROM g) * w{j}" for j in range(n))
        + f" - (SELECT b{i} FROM g)) AS nw{i}" for i in range(n))
    diff = " + ".join(f"(nw{i} - w{i}) * (nw{i} - w{i})" for i in range(n))
    norm = " + ".join(f"nw{i} * nw{i}" for i in range(n))
    e_hat = " + ".join(f"(SELECT w{i} FROM r) * cast({f[i]} AS double)" for i in range(n))
    return _with(CAL, f"""g AS (SELECT {gram} FROM d WHERE delta_e IS NOT NULL),
r AS (
  WITH RECURSIVE it(t, {ws}, done) AS (
    SELECT 0, {w0}, false
    UNION ALL
    SELECT t + 1, {nws},
           (t + 1 >= 2) AND sqrt({diff}) < 0.001 * greatest(sqrt({norm}), 1.0)
    FROM (SELECT t, {ws}, done,
                 {upd}
          FROM it WHERE t < 100 AND NOT done) q
  )
  SELECT * FROM it ORDER BY t DESC LIMIT 1),
sc AS (SELECT d.*, {e_hat} AS e_hat FROM d),
sc2 AS (SELECT *, predicted + e_hat AS improved FROM sc),
agg AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')},
       {metric_aggs('improved', 'observed', 'i_')},
       {metric_aggs('e_hat', 'delta_e', 'd_')},
       count(delta_e) AS n_eval,
       sqrt(avg(CASE WHEN delta_e IS NOT NULL THEN (e_hat - delta_e) * (e_hat - delta_e) END)) AS h
  FROM sc2)""") + "\n" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS series, {metric_final(p)}, 'sgd' AS technique, "
        f"'train' AS eval_scope, n_eval, {rnd_sql('h', DIGITS['rmse'])} AS holdout_rmse FROM agg"
        for name, p in [("original", "o_"), ("improved", "i_"), ("delta_error", "d_")])


SQL["correct_sgd"] = _sgd_full()


def _glr_full() -> str:
    """Five-feature GLR (gaussian, identity, regParam 0.3) in closed form:
    on standardised data (population std) the coefficients solve
    (R + k I) b = r with R the feature correlations, r the feature-label
    correlations and k = 0.3 / std(label); solved by a straight-line
    Cholesky factorisation, then mapped back to the original scale."""
    f = ["yr", "mon", "dom", "n_lines", "qty"]
    n = len(f)
    x = [f"cast({c} AS double)" for c in f]
    stats = ", ".join(
        ["avg(delta_e) AS my", "stddev_pop(delta_e) AS sy", "0.3 / stddev_pop(delta_e) AS k"]
        + [f"avg({x[i]}) AS m{i}, stddev_pop({x[i]}) AS s{i}, corr(delta_e, {x[i]}) AS r{i}"
           for i in range(n)]
        + [f"corr({x[i]}, {x[j]}) AS c{i}{j}" for i in range(n) for j in range(i + 1, n)])
    ctes = [f"st AS (SELECT {stats} FROM d WHERE delta_e IS NOT NULL)"]
    prev = "st"

    def a(i, j):
        return "(1 + k)" if i == j else f"c{min(i, j)}{max(i, j)}"

    step = 0
    for j in range(n):            # Cholesky, column by column
        cols = [f"sqrt({a(j, j)}" + "".join(f" - l{j}{q} * l{j}{q}" for q in range(j)) + f") AS l{j}{j}"]
        name = f"ch{step}"; step += 1
        ctes.append(f"{name} AS (SELECT *, {', '.join(cols)} FROM {prev})"); prev = name
        rest = [f"({a(i, j)}" + "".join(f" - l{i}{q} * l{j}{q}" for q in range(j)) + f") / l{j}{j} AS l{i}{j}"
                for i in range(j + 1, n)]
        if rest:
            name = f"ch{step}"; step += 1
            ctes.append(f"{name} AS (SELECT *, {', '.join(rest)} FROM {prev})"); prev = name
    for i in range(n):            # forward substitution  L z = r
        e = f"(r{i}" + "".join(f" - l{i}{q} * z{q}" for q in range(i)) + f") / l{i}{i} AS z{i}"
        name = f"fw{i}"
        ctes.append(f"{name} AS (SELECT *, {e} FROM {prev})"); prev = name
    for i in reversed(range(n)):  # back substitution  L' b = z
        e = f"(z{i}" + "".join(f" - l{q}{i} * b{q}" for q in range(i + 1, n)) + f") / l{i}{i} AS b{i}"
        name = f"bw{i}"
        ctes.append(f"{name} AS (SELECT *, {e} FROM {prev})"); prev = name
    coef = ", ".join(f"b{i} * sy / s{i} AS w{i}" for i in range(n))
    ctes.append(f"cf AS (SELECT *, {coef} FROM {prev})")
    icpt = "my" + "".join(f" - w{i} * m{i}" for i in range(n))
    ctes.append(f"cf2 AS (SELECT *, {icpt} AS w_icpt FROM cf)")
    e_hat = "(SELECT w_icpt FROM cf2)" + "".join(
        f" + (SELECT w{i} FROM cf2) * {x[i]}" for i in range(n))
    ctes.append(f"sc AS (SELECT d.*, {e_hat} AS e_hat FROM d)")
    ctes.append("sc2 AS (SELECT *, predicted + e_hat AS improved FROM sc)")
    ctes.append(f"""agg AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')},
       {metric_aggs('improved', 'observed', 'i_')},
       {metric_aggs('e_hat', 'delta_e', 'd_')},
       count(delta_e) AS n_eval,
       sqrt(avg(CASE WHEN delta_e IS NOT NULL THEN (e_hat - delta_e) * (e_hat - delta_e) END)) AS h
  FROM sc2)""")
    return _with(CAL, *ctes) + "\n" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS series, {metric_final(p)}, 'glr' AS technique, "
        f"'train' AS eval_scope, n_eval, {rnd_sql('h', DIGITS['rmse'])} AS holdout_rmse FROM agg"
        for name, p in [("original", "o_"), ("improved", "i_"), ("delta_error", "d_")])


SQL["correct_glr"] = _glr_full()


SQL["glr_report_by_year"] = _with(CAL, GLR, f"""agg AS (
  SELECT yr, {metric_aggs('predicted', 'observed', 'o_')},
       {metric_aggs('improved', 'observed', 'i_')},
       {metric_aggs('e_hat', 'delta_e', 'd_')}
  FROM sc2 GROUP BY yr)""") + "\n" + "\nUNION ALL ".join(
    f"SELECT yr, '{name}' AS series, {metric_final(p)} FROM agg"
    for name, p in [("original", "o_"), ("improved", "i_"), ("delta_error", "d_")])


# Gaussian GLR fit statistics (rank 3: two features and the intercept).
SQL["glr_fit_statistics"] = _with(CAL, GLR, """fs AS (
  SELECT count(delta_e) AS n,
         sum((delta_e - e_hat) * (delta_e - e_hat)) AS dev,
         var_pop(delta_e) * count(delta_e) AS nulldev
  FROM sc)""") + f"""
SELECT {rnd_sql('dev / (n - 3)', 0)} AS dispersion,
       {rnd_sql('nulldev', -4)} AS null_deviance,
       {rnd_sql('dev', -4)} AS deviance,
       cast(n - 1 AS bigint) AS residual_dof_null,
       cast(n - 3 AS bigint) AS residual_dof,
       {rnd_sql('n * (ln(2 * pi() * dev / n) + 1) + 2 + 2 * 3', 6)} AS aic
FROM fs"""


SQL["prediction_list_attached"] = _with(_SERIES) + """
SELECT vec_id, time, v AS observed,
       cast(cast(round(v * CAST(1e6 AS double)) AS bigint) AS double) AS value
FROM s"""


# the streamed report must equal the batch one
SQL["stream_glr_report"] = SQL["glr_report"]


# ------------------------------------------------------------ files, written and read back

SQL["calibration_csv"] = _with(CAL) + """
SELECT row_id, observed, predicted, cast(yr AS double) AS yr, cast(mon AS double) AS mon, cast(dom AS double) AS dom,
       cast(n_lines AS double) AS n_lines, qty FROM cal"""

SQL["delta_table_file"] = SQL["delta_table"]

SQL["libsvm_files"] = _with(_EV) + """
SELECT cast(hour AS double) AS label, cast(day AS double) AS day, cast(minute AS double) AS minute, cast(cents AS double) AS cents FROM ev"""

SQL["labelled_csv_file"] = SQL["libsvm_files"]

SQL["series_csv_file"] = _with(_SERIES) + """
SELECT time, v * CAST(0.9 AS double) AS predicted, v AS observed, v - v * CAST(0.9 AS double) AS delta FROM s"""

SQL["predictions_file"] = _with(CAL, STUMP) + f"""
SELECT row_id, {rnd_sql('e_hat', 4)} AS prediction FROM sc"""

_HOLDOUT = f"(SELECT sqrt(avg((e_hat - delta_e) * (e_hat - delta_e))) FROM sc WHERE {BUCKET} >= 70)"
SQL["accuracy_line"] = _with(CAL, STUMP) + f"""
SELECT 'Root Mean Squared Error (RMSE) on test data = ' || printf('%g', {_HOLDOUT}) AS line"""


# One-feature GLR on n_lines in closed form (see GLR).
GLR1 = """
s1 AS (SELECT avg(delta_e) my, avg(n_lines) mx, stddev_pop(delta_e) sy, stddev_pop(n_lines) sx, corr(delta_e, n_lines) r,
              0.3 / stddev_pop(delta_e) k FROM d),
c1 AS (SELECT r / (1 + k) * sy / sx AS b1, my - r / (1 + k) * sy / sx * mx AS b0 FROM s1)"""

SQL["labelled_fit"] = _with(CAL, GLR1, """e AS (
  SELECT avg(((SELECT b0 FROM c1) + (SELECT b1 FROM c1) * n_lines - delta_e) * ((SELECT b0 FROM c1) + (SELECT b1 FROM c1) * n_lines - delta_e)) AS m,
         count(*) AS n FROM d)""") + f"""
SELECT 'glr' AS technique, 'train' AS eval_scope, n AS n_eval, {rnd_sql('sqrt(m)', DIGITS['rmse'])} AS rmse,
       {rnd_sql('m', DIGITS['mse'])} AS all_rows_mse FROM e"""


# ------------------------------------------------------------ learners whose result SQL can state

SQL["rf_stump_report"] = SQL["stump_report"]


def _stump_on(name: str, rows: str) -> str:
    """The best depth-1 split of column y on x over ``rows``, as a CTE."""
    return f"""{name}_g AS (SELECT x, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM {rows} GROUP BY x),
{name}_t AS (SELECT sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy FROM {name}_g),
{name}_c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS nl, sum(sy) OVER (ORDER BY x) AS syl,
                    sum(syy) OVER (ORDER BY x) AS syyl FROM {name}_g),
{name} AS (SELECT (x + nx) / 2.0 AS threshold, syl / nl AS left_mean, (t.sy - syl) / (t.n - nl) AS right_mean
           FROM {name}_c, {name}_t t WHERE nx IS NOT NULL
           ORDER BY (syyl - syl * syl / nl) + (t.syy - syyl - (t.sy - syl) * (t.sy - syl) / (t.n - nl)) LIMIT 1)"""


def _leaf(name: str, x: str) -> str:
    return f"CASE WHEN {x} <= (SELECT threshold FROM {name}) THEN (SELECT left_mean FROM {name}) ELSE (SELECT right_mean FROM {name}) END"


# Boosting with squared loss: the second tree learns twice the residual of the
# first and is added with the step size 0.1.
SQL["gbt_stump_report"] = _with(
    CAL, f"tr1 AS (SELECT n_lines AS x, delta_e AS y FROM d WHERE {BUCKET} < 70)", _stump_on("t1", "tr1"),
    f"tr2 AS (SELECT x, 2 * (y - ({_leaf('t1', 'x')})) AS y FROM tr1)", _stump_on("t2", "tr2"),
    f"sc AS (SELECT d.*, ({_leaf('t1', 'n_lines')}) + 0.1 * ({_leaf('t2', 'n_lines')}) AS e_hat FROM d)",
    "sc2 AS (SELECT *, predicted + e_hat AS improved FROM sc)", three_way("sc2"))

# One-feature elastic net on standardised data: soft threshold, then shrinkage
# (regParam 0.3, elasticNetParam 0.8, both over the label's deviation).
SQL["linear_one_feature"] = _with(CAL, f"""s AS (
  SELECT avg(delta_e) my, avg(n_lines) mx, stddev_pop(delta_e) sy, stddev_pop(n_lines) sx, corr(delta_e, n_lines) r FROM d WHERE {BUCKET} < 70),
b AS (SELECT *, sign(r) * greatest(abs(r) - 0.8 * 0.3 / sy, 0) / (1 + 0.2 * 0.3 / sy) * sy / sx AS w FROM s)""") + f"""
SELECT 'n_lines' AS feature, {rnd_sql('w', 2)} AS coefficient FROM b
UNION ALL SELECT '(intercept)', {rnd_sql('my - w * mx', 2)} FROM b"""

SQL["stump_summary"] = _with(CAL, STUMP) + """
SELECT 'decision_tree' AS technique, cast(1 AS int) AS num_trees, cast(1 AS int) AS depth, cast(3 AS int) AS num_nodes,
       'n_lines' AS feature, CAST(1.0 AS double) AS importance FROM best"""


def _comparison() -> str:
    sgd = """sg AS (SELECT avg(n_lines * n_lines) AS gxx, avg(n_lines * delta_e) AS gxy FROM d),
sw AS (
  WITH RECURSIVE it(t, w, done) AS (
    SELECT 0, CAST(0.0 AS double), false
    UNION ALL
    SELECT t + 1, nw, (t + 1 >= 2) AND abs(nw - w) < 0.001 * greatest(abs(nw), 1.0)
    FROM (SELECT t, w, done, w - (CAST(1e-8 AS double) / sqrt(t + 1)) * ((SELECT gxx FROM sg) * w - (SELECT gxy FROM sg)) AS nw
          FROM it WHERE t < 100 AND NOT done) q)
  SELECT w FROM it ORDER BY t DESC LIMIT 1)"""
    hats = {"glr": "(SELECT b0 FROM c1) + (SELECT b1 FROM c1) * n_lines", "sgd": "(SELECT w FROM sw) * n_lines", "decision_tree": _leaf("best", "n_lines")}
    ctes, parts = [CAL, GLR1, sgd, STUMP], []
    for t, e in hats.items():
        held = f"{BUCKET} >= 70" if t == "decision_tree" else "true"
        ctes.append(f"e_{t} AS (SELECT d.*, {e} AS e_hat FROM d)")
        ctes.append(f"""a_{t} AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')}, {metric_aggs('predicted + e_hat', 'observed', 'i_')}, {metric_aggs('e_hat', 'delta_e', 'd_')},
         count(CASE WHEN {held} THEN 1 END) AS n_eval, sqrt(avg(CASE WHEN {held} THEN (e_hat - delta_e) * (e_hat - delta_e) END)) AS h FROM e_{t})""")
        scope = "holdout" if t == "decision_tree" else "train"
        parts += [f"SELECT '{s}' AS series, {metric_final(p)}, '{t}' AS technique, '{scope}' AS eval_scope, n_eval, {rnd_sql('h', DIGITS['rmse'])} AS holdout_rmse FROM a_{t}"
                  for s, p in [("original", "o_"), ("improved", "i_"), ("delta_error", "d_")]]
    return _with(*ctes) + "\n" + "\nUNION ALL ".join(parts)


SQL["comparison_one_feature"] = _comparison()

_WHOLE = "cast(cast(round({}) AS bigint) AS varchar)"
SQL["report_json_rounded"] = _with(CAL, GLR, f"""rep AS (
{three_way("sc2").replace("agg AS (", "SELECT * FROM (WITH agg AS (", 1)}))""") + """
SELECT '{' || string_agg('"' || series || '_' || m || '":' || """ + _WHOLE.format("v") + """, ',' ORDER BY o, k)
       || ',"accuracy_info":"Root Mean Squared Error (RMSE) on test data = ' || printf('%g', any_value(h)) || '\\n","holdout_rmse":' || """ + _WHOLE.format("any_value(h)") + """ || '}' AS report
FROM (SELECT series, CASE series WHEN 'original' THEN 0 WHEN 'improved' THEN 1 ELSE 2 END AS o, unnest(['rmse', 'pbias', 'cd', 'nse']) AS m,
             unnest([0, 1, 2, 3]) AS k, unnest([rmse, pbias, cd, nse]) AS v, (SELECT round(sqrt(avg((e_hat - delta_e) * (e_hat - delta_e)))) FROM sc) AS h FROM rep)"""

SQL["row_by_label"] = _with(CAL, STUMP) + f"""
SELECT cast(json_object('row_id', row_id, 'prediction', {rnd_sql('e_hat', 2)}) AS varchar) AS json
FROM sc WHERE delta_e BETWEEN -1000 AND 1000 ORDER BY row_id LIMIT 1"""


# ------------------------------------------------------------ files, lists and splits of round 3

SQL["calibration_csv_two_orders"] = SQL["calibration_csv"]

SQL["prediction_file"] = _with(_EV) + """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, cast(cents AS double) AS value FROM ev"""

SQL["report_series"] = _with(CAL, GLR) + """,
n AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS i, cast(round(predicted) AS bigint) AS p, cast(round(improved) AS bigint) AS m,
             cast(round(observed) AS bigint) AS o FROM sc2)
SELECT i // 1000 AS chunk,
       '{"start":' || (i // 1000 * 1000) || ',"original_p_list":[' || string_agg(p, ',' ORDER BY i) || '],"improved_p_list":['
       || string_agg(m, ',' ORDER BY i) || '],"o_list":[' || string_agg(o, ',' ORDER BY i) || ']}' AS line
FROM n GROUP BY i // 1000"""

SQL["series_rows_sliced"] = SQL["series_rows"]

SQL["random_split_sides"] = _with(CAL) + "\nSELECT row_id, cast(1 AS bigint) AS n_sides FROM cal"


# ------------------------------------------------------------ trees of depth 5 on features of at most 32 values

COARSE = ("yr", "mon", "dom", "n_lines")


def _tree(name: str, rows: str, depth: int = 5, least: int = 1) -> str:
    """A regression tree over ``rows`` (row_id, t: in training, y, x: list of
    features), level by level: of all midpoints between neighbouring training
    values (CTE ``cuts``) that leave ``least`` rows of the node on either side the
    one that lowers the squared error most (equal ones: the first feature, the
    smallest midpoint); a node is split while that gains.  The last CTE, ``name``, has row_id and e: the mean of the training rows."""
    out, prev = [], f"(SELECT row_id, t, y, x, 1 AS node FROM {rows})"
    for k in range(depth):
        out.append(f"""{name}_h{k} AS (
  SELECT node, f, v, count(*) AS n, sum(y) AS s, sum(y * y) AS q
  FROM (SELECT node, y, unnest(range({len(COARSE)})) AS f, unnest(x) AS v FROM {prev} WHERE t) GROUP BY ALL),
{name}_c{k} AS (
  SELECT node, f, threshold, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(q) OVER w AS ql,
         sum(n) OVER a AS n, sum(s) OVER a AS s, sum(q) OVER a AS q
  FROM {name}_h{k} JOIN cuts USING (f, v) WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
{name}_b{k} AS (
  SELECT node, f, threshold, gain
  FROM (SELECT *, (q - s * s / n) - (ql - sl * sl / nl) - (q - ql - (s - sl) * (s - sl) / (n - nl)) AS gain, q - s * s / n AS error
        FROM {name}_c{k} WHERE nl >= {least} AND n - nl >= {least})
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain / error, 9) DESC, f, threshold) = 1),
{name}_r{k} AS (
  SELECT row_id, t, y, x, CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN x[b.f + 1] <= threshold THEN 0 ELSE 1 END END AS node
  FROM {prev} r LEFT JOIN {name}_b{k} b ON r.node = b.node)""")
        prev = f"{name}_r{k}"
    out.append(f"""{name} AS (
  SELECT row_id, e FROM {prev} r JOIN (SELECT node, avg(y) FILTER (t) AS e FROM {prev} GROUP BY node) m ON r.node = m.node)""")
    return ",\n".join(out)


_COARSE_ROWS = f"""rows0 AS (SELECT row_id, {BUCKET} < 70 AS t, delta_e AS y, [{', '.join(f'cast({c} AS double)' for c in COARSE)}] AS x FROM d),
cuts AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2.0 AS threshold
         FROM (SELECT DISTINCT unnest(range({len(COARSE)})) AS f, unnest(x) AS v FROM rows0 WHERE t))"""


def _holdout_report(technique: str) -> str:
    """The full report over sc2 for a technique that is evaluated on its holdout."""
    return f"""agg AS (
  SELECT {metric_aggs('predicted', 'observed', 'o_')},
       {metric_aggs('improved', 'observed', 'i_')},
       {metric_aggs('e_hat', 'delta_e', 'd_')},
       count(CASE WHEN {BUCKET} >= 70 THEN 1 END) AS n_eval,
       sqrt(avg(CASE WHEN {BUCKET} >= 70 THEN (e_hat - delta_e) * (e_hat - delta_e) END)) AS h
  FROM sc2)""" + "\n" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS series, {metric_final(p)}, '{technique}' AS technique, 'holdout' AS eval_scope, n_eval, "
        f"{rnd_sql('h', DIGITS['rmse'])} AS holdout_rmse FROM agg"
        for name, p in [("original", "o_"), ("improved", "i_"), ("delta_error", "d_")])


_SCORED = "sc2 AS (SELECT d.*, e AS e_hat, predicted + e AS improved FROM d JOIN {} USING (row_id))"
SQL["tree_depth5_report"] = _with(CAL, _COARSE_ROWS, _tree("tree", "rows0"), _SCORED.format("tree"), _holdout_report("decision_tree"))

SQL["tree_depth5_summary"] = _with(CAL, _COARSE_ROWS, _tree("tree", "rows0")) + f""",
splits AS ({' UNION ALL '.join(f'SELECT {k} AS level, f, gain FROM tree_b{k}' for k in range(5))})
SELECT 'decision_tree' AS technique, cast(1 AS int) AS num_trees, cast((SELECT max(level) + 1 FROM splits) AS int) AS depth,
       cast((SELECT 2 * count(*) + 1 FROM splits) AS int) AS num_nodes, feature,
       {rnd_sql('coalesce((SELECT sum(gain) FROM splits WHERE f = i), 0.0) / (SELECT sum(gain) FROM splits)', 8)} AS importance
FROM (SELECT unnest({list(COARSE)}) AS feature, unnest(range({len(COARSE)})) AS i)"""


def _boosted(rounds: int = 10, step: float = 0.1, least: int = 20) -> str:
    """Squared loss: each further tree learns twice the residual and is added
    with the step size; the first one counts whole."""
    ctes = [_COARSE_ROWS, _tree("tree0", "rows0", least=least), "sum0 AS (SELECT row_id, e FROM tree0)"]
    for m in range(1, rounds):
        ctes += [f"rows{m} AS (SELECT r.row_id, t, 2 * (y - e) AS y, x FROM rows0 r JOIN sum{m - 1} USING (row_id))", _tree(f"tree{m}", f"rows{m}", least=least),
                 f"sum{m} AS (SELECT row_id, s.e + {step} * b.e AS e FROM sum{m - 1} s JOIN tree{m} b USING (row_id))"]
    return _with(CAL, *ctes, _SCORED.format(f"sum{rounds - 1}"), _holdout_report("gb_tree"))


SQL["gbt_depth5_report"] = _boosted()
SQL["rf_depth5_report"] = _with(CAL, _COARSE_ROWS, _tree("tree", "rows0"), _SCORED.format("tree"), _holdout_report("rf"))


# ------------------------------------------------------------ linear learners of round 3

_FIVE = ["yr", "mon", "dom", "n_lines", "qty"]


def _elastic_net(sweeps: int = 400, reg: float = 0.3, share: float = 0.8) -> str:
    """Elastic net on standardised data (training rows, population deviations) by
    cyclic coordinate descent: each coefficient is the soft threshold of what the
    others leave, shrunk by the squared penalty."""
    n = len(_FIVE)
    x = [f"cast({c} AS double)" for c in _FIVE]
    stats = ", ".join(["avg(delta_e) AS my", "stddev_pop(delta_e) AS sy"]
                      + [f"avg({x[i]}) AS m{i}, stddev_pop({x[i]}) AS s{i}, corr(delta_e, {x[i]}) AS r{i}" for i in range(n)]
                      + [f"corr({x[i]}, {x[j]}) AS c{i}{j}" for i in range(n) for j in range(i + 1, n)])
    inner = f"(SELECT it.*, st.* FROM it, st WHERE sweep < {sweeps})"
    for i in range(n):
        left = f"(r{i}" + "".join(f" - c{min(i, j)}{max(i, j)} * {'n' if j < i else 'w'}{j}" for j in range(n) if j != i) + ")"
        inner = f"(SELECT *, sign({left}) * greatest(abs({left}) - {reg * share} / sy, 0) / (1 + {reg * (1 - share):.17g} / sy) AS n{i} FROM {inner})"
    return _with(CAL, f"st AS (SELECT {stats} FROM d WHERE {BUCKET} < 70)", f"""fit AS (
  WITH RECURSIVE it(sweep, {', '.join(f'w{i}' for i in range(n))}) AS (
    SELECT 0, {', '.join(['CAST(0.0 AS double)'] * n)}
    UNION ALL SELECT sweep + 1, {', '.join(f'n{i}' for i in range(n))} FROM {inner})
  SELECT {', '.join(f'w{i} * sy / s{i} AS b{i}' for i in range(n))}, my, {', '.join(f'm{i}' for i in range(n))} FROM it, st WHERE sweep = {sweeps})""") + "\n" + "\nUNION ALL ".join(
        [f"SELECT '{_FIVE[i]}' AS feature, {rnd_sql(f'b{i}', 1)} AS coefficient FROM fit" for i in range(n)]
        + [f"SELECT '(intercept)', {rnd_sql('my' + ''.join(f' - b{i} * m{i}' for i in range(n)), -2)} FROM fit"])


SQL["linear_five_features"] = _elastic_net()


def _inference() -> str:
    """Two features: the inverse of the (penalised) correlation matrix in closed
    form; p by Simpson's rule over the t density."""
    steps = 4000
    parts = []
    for reg in (0.0, 0.3):
        ctes = f"""k{int(reg * 10)} AS (SELECT *, {reg} / sy AS k FROM im),
i{int(reg * 10)} AS (SELECT *, (1 + k) / ((1 + k) * (1 + k) - rho * rho) AS dd, -rho / ((1 + k) * (1 + k) - rho * rho) AS oo FROM k{int(reg * 10)}),
f{int(reg * 10)} AS (SELECT *, (dd * r1 + oo * r2) * sy / s1 AS b1, (oo * r1 + dd * r2) * sy / s2 AS b2 FROM i{int(reg * 10)}),
e{int(reg * 10)} AS (SELECT f.*, my - b1 * m1 - b2 * m2 AS b0,
       (SELECT sum((delta_e - my - b1 * (qty - m1) - b2 * (n_lines - m2)) * (delta_e - my - b1 * (qty - m1) - b2 * (n_lines - m2))) FROM d) / (n - 3) AS disp FROM f{int(reg * 10)} f)"""
        rows = " UNION ALL ".join([
            f"SELECT {reg} AS reg_param, 'qty' AS feature, b1 AS b, sqrt(disp * dd / (n * s1 * s1)) AS se, n FROM e{int(reg * 10)}",
            f"SELECT {reg}, 'n_lines', b2, sqrt(disp * dd / (n * s2 * s2)), n FROM e{int(reg * 10)}",
            f"SELECT {reg}, '(intercept)', b0, sqrt(disp * (1 + dd * (m1 / s1) * (m1 / s1) + dd * (m2 / s2) * (m2 / s2) + 2 * oo * (m1 / s1) * (m2 / s2)) / n), n FROM e{int(reg * 10)}"])
        parts.append((ctes, rows))
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + z * z / v))"
    return _with(CAL, """im AS (SELECT count(*) AS n, avg(delta_e) my, avg(qty) m1, avg(n_lines) m2, stddev_pop(delta_e) sy, stddev_pop(qty) s1,
       stddev_pop(n_lines) s2, corr(delta_e, qty) r1, corr(delta_e, n_lines) r2, corr(qty, n_lines) rho FROM d)""",
                 *[c for c, _ in parts], f"al AS ({' UNION ALL '.join(r for _, r in parts)})",
                 "tv AS (SELECT *, b / se AS t, cast(n - 3 AS double) AS v, least(abs(b / se), 40.0) AS upto FROM al)",
                 f"""pv AS (
  SELECT reg_param, feature, 1 - 2 * sum({density} * CASE WHEN j IN (0, {steps}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * any_value(upto) / {steps} / 3 AS p
  FROM (SELECT reg_param, feature, v, upto, j, upto * j / {steps} AS z FROM tv, range({steps + 1}) g(j)) GROUP BY reg_param, feature)""") + f"""
SELECT cast(reg_param AS double) AS reg_param, feature, {rnd_sql('b', 6)} AS coefficient, {rnd_sql('se', 6)} AS standard_error, {rnd_sql('t', 6)} AS t_value,
       {rnd_sql('greatest(p, 0.0)', 5)} AS p_value
FROM tv JOIN pv USING (reg_param, feature)"""


SQL["glr_inference"] = _inference()


def _wide_descent(n: int = 16, iterations: int = 60) -> str:
    """Full-batch gradient descent (step 1 / sqrt(t), no intercept) on the first
    columns of the embeddings, from their mean products."""
    x = [f"cast(embedding[{i + 1}] AS double)" for i in range(n)]
    gram = ", ".join([f"avg({x[i]} * {x[j]}) AS g{i}_{j}" for i in range(n) for j in range(i, n)] + [f"avg({x[i]} * label) AS b{i}" for i in range(n)])
    step = ", ".join(f"w{i} - (1.0 / sqrt(t + 1)) * (" + " + ".join(f"g{min(i, j)}_{max(i, j)} * w{j}" for j in range(n)) + f" - b{i})" for i in range(n))
    ws = ", ".join(f"w{i}" for i in range(n))
    return f"""WITH g AS (SELECT {gram} FROM embeddings),
r AS (
  WITH RECURSIVE it(t, {ws}) AS (
    SELECT 0, {', '.join(['CAST(0.0 AS double)'] * n)}
    UNION ALL SELECT t + 1, {step} FROM it, g WHERE t < {iterations})
  SELECT * FROM it WHERE t = {iterations})
""" + "\nUNION ALL ".join(f"SELECT 'x{i}' AS feature, {rnd_sql(f'w{i}', 8)} AS weight FROM r" for i in range(n))


SQL["sgd_wide"] = _wide_descent()
