"""The same results as the named analyses, in SQL over the source tables (DuckDB dialect)."""

from __future__ import annotations

from visitframe.functions import noise
from visitframe.spec import PANEL

V = range(7)
FAMS = PANEL.families
COVS = "TRIAL, SEX, AGE, EDU, BMI, INKOMEN, JOB, ADL, WZC"


def R(x, d=6):
    """Rounded off the ties that exact decimals fall on; adding zero turns -0 into 0."""
    return f"round(({x}) + 3.07e-{d + 2}, {d}) + 0e0"


def R4(x):
    """For results of iterative fits."""
    return R(x, 4)


def _wide(source, fams=FAMS):
    cols = ", ".join(f"max({f}) FILTER (WHERE TIME = {t}) AS {f}{t}" for f in fams for t in V)
    return f"SELECT PATID, {cols} FROM {source} GROUP BY PATID"


ALLV = [f"{f}{t}" for f in FAMS for t in V]
BPRS = [f"bprs{t}" for t in V]
CDRSB = [f"cdrsb{t}" for t in V]

BASE = f"""
cells AS (SELECT o_custkey, CAST(year(o_orderdate) - 1995 AS INTEGER) AS t, max(o_totalprice) / 25000e0 AS cdrsb,
  avg(o_totalprice) / 10000e0 AS bprs, min(o_totalprice) / 100000e0 AS abpet, CAST(count(*) AS DOUBLE) AS taupet
  FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL),
cov AS (SELECT c_custkey AS PATID, n_regionkey AS TRIAL, c_custkey % 2 AS SEX,
  55e0 + (c_acctbal + 1000e0) / 400e0 AS AGE, c_mktsegment AS EDU, 18e0 + 0.6e0 * c_nationkey AS BMI,
  1000e0 + 25e0 * (c_custkey % 97) AS INKOMEN, (c_custkey // 2) % 2 AS JOB,
  1 + 2 * ((c_custkey * 7) % 11) AS ADL, CAST(c_acctbal < 0 AS INTEGER) AS WZC
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
visits AS (SELECT CAST(range AS INTEGER) AS TIME FROM range(7)),
long AS (SELECT cov.*, TIME, cdrsb, bprs, abpet, taupet FROM cov CROSS JOIN visits
  LEFT JOIN cells ON o_custkey = PATID AND t = TIME),
panel AS (SELECT * FROM cov JOIN ({_wide("long")}) USING (PATID)),
seen AS (SELECT *, min(CASE WHEN cdrsb IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY PATID ORDER BY TIME) AS s,
  max(CASE WHEN TIME = 0 AND cdrsb IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY PATID) AS at0 FROM long),
mlong AS (SELECT PATID, {COVS}, TIME, {", ".join(f"CASE WHEN s = 1 THEN {f} END AS {f}" for f in FAMS)}
  FROM seen WHERE at0 = 1),
mono AS (SELECT * FROM (SELECT DISTINCT PATID, {COVS} FROM mlong) JOIN ({_wide("mlong")}) USING (PATID)),
cc AS (SELECT *, CASE WHEN cdrsb < 10 THEN 0 ELSE 1 END AS cdrsb_cat FROM long WHERE cdrsb IS NOT NULL),
ccw AS (SELECT * FROM panel WHERE {" AND ".join(f"cdrsb{t} IS NOT NULL" for t in V)}),
fam AS ({" UNION ALL ".join(f"SELECT TRIAL + 1 AS imp, TIME, '{f}' AS term, {f} AS y FROM cc" for f in FAMS)}),
rp AS (SELECT imp, term, regr_slope(y, TIME) AS estimate,
  sqrt((regr_syy(y, TIME) - regr_slope(y, TIME) * regr_sxy(y, TIME)) / (count(*) - 2) / regr_sxx(y, TIME)) AS std_error
  FROM fam GROUP BY ALL),
risk AS (SELECT PATID, SEX, TIME, cdrsb AS prev, nxt,
  CAST(nxt IS NOT NULL AS INTEGER) AS R FROM (SELECT *, lead(cdrsb) OVER w AS nxt,
    coalesce(min(CASE WHEN TIME = 0 OR cdrsb IS NOT NULL THEN 1 ELSE 0 END)
      OVER (PARTITION BY PATID ORDER BY TIME), 1) AS ok
    FROM long WINDOW w AS (PARTITION BY PATID ORDER BY TIME)) WHERE TIME < 6 AND cdrsb IS NOT NULL AND ok = 1),
psex AS (SELECT SEX, avg(CAST(R AS DOUBLE)) AS p FROM risk GROUP BY SEX),
wts AS (SELECT cc.PATID, cc.TIME, cc.SEX, cc.cdrsb, p.p AS prob_obs FROM cc
  LEFT JOIN risk ON risk.PATID = cc.PATID AND risk.TIME + 1 = cc.TIME
  LEFT JOIN psex p ON p.SEX = risk.SEX),
cumw AS (SELECT *, exp(sum(coalesce(ln(1 / prob_obs), 0)) OVER (PARTITION BY PATID ORDER BY TIME)) AS W FROM wts),
vsex AS (SELECT SEX, avg(CASE WHEN cdrsb IS NULL THEN 0e0 ELSE 1e0 END) AS p FROM long GROUP BY SEX),
visitw AS (SELECT cc.*, v.p AS prob_obs, 1 / v.p AS W FROM cc JOIN vsex v USING (SEX)),
line AS (SELECT regr_slope(bprs, TIME) AS b, regr_intercept(bprs, TIME) AS a, count(*) AS n, regr_sxx(bprs, TIME) AS sxx,
  regr_syy(bprs, TIME) AS syy, regr_sxy(bprs, TIME) AS sxy, avg(TIME) AS tm FROM cc),
ev AS (SELECT TIME, avg((bprs - a - b * TIME) * (bprs - a - b * TIME)) AS empirical_variance FROM cc, line GROUP BY TIME),
pooled AS (SELECT *, within + (1 + 1e0 / m) * between_ AS total FROM (SELECT term, count(*) AS m, avg(estimate) AS estimate,
  avg(std_error * std_error) AS within, var_samp(estimate) AS between_ FROM rp GROUP BY term)),
comp AS (SELECT TRIAL + 1 AS imp, unnest(['UN(1,1)', 'UN(2,1)', 'UN(2,2)', 'Residual']) AS cov_parm,
  unnest([var_samp(bprs0), covar_samp(bprs0, bprs6 - bprs0), var_samp(bprs6 - bprs0), var_samp(bprs3)]) AS estimate
  FROM panel GROUP BY TRIAL),
pcomp AS (SELECT *, avg_ + (1 + 1e0 / m) * between_ AS plus FROM (SELECT cov_parm, avg(estimate) AS avg_,
  var_samp(estimate) AS between_, count(*) AS m FROM comp GROUP BY cov_parm)),
grid AS (SELECT CAST(range AS INTEGER) AS time_tenths, range / 10e0 AS TIME FROM range(61)),
vc AS (SELECT time_tenths, d11 + 2 * TIME * d12 + TIME * TIME * d22 + s2 AS var_avg,
  e11 + 2 * TIME * e12 + TIME * TIME * e22 + e2 AS var_rubin FROM grid, (SELECT
  {", ".join(f"max({c}) FILTER (WHERE cov_parm = '{n}') AS {a}" for c, k in (("avg_", "d"), ("plus", "e"))
             for n, a in (("UN(1,1)", k + "11"), ("UN(2,1)", k + "12"), ("UN(2,2)", k + "22"),
                          ("Residual", "s2" if k == "d" else "e2")))} FROM pcomp)),
score AS (SELECT PATID, TIME, bprs + 6e0 * (PATID % 7 - 3) + 2e0 * (PATID % 5 - 2) * TIME AS y FROM cc
  WHERE PATID IN (SELECT PATID FROM ccw)),
sub AS (SELECT PATID, regr_intercept(y, TIME) AS b0, regr_slope(y, TIME) AS b1,
  regr_syy(y, TIME) - regr_slope(y, TIME) * regr_sxy(y, TIME) AS sse FROM score GROUP BY PATID),
bal AS (SELECT *, v00 - s2 * 13e0 / 28 AS d11, v01 + s2 * 3e0 / 28 AS d12, v11 - s2 / 28e0 AS d22 FROM (
  SELECT count(*) AS n, avg(b0) AS m0, avg(b1) AS m1, var_samp(b0) AS v00, covar_samp(b0, b1) AS v01,
  var_samp(b1) AS v11, sum(sse) / (count(*) * 5e0) AS s2 FROM sub))
"""


def q(body, *ctes):
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + body


def _mix_chain(start, a, keys):
    """The keyed-noise mixing of one lane as a list reduction."""
    step = f"(xor(h, k) * {a}) % {noise.P}"
    items = ", ".join(f"CAST({x} AS BIGINT)" for x in [start, *keys])
    return f"list_reduce([{items}], lambda h, k: xor({step}, ({step}) >> 15))"


def plugin_ctes(m=4, seed=7, shifts=(("", 0.0),)):
    """Plugged-in monotone imputation of bprs with the library's keyed noise."""
    keys = ", ".join(f"({i}, {j}, {noise.fold((seed, i, j, 0))})" for i in range(1, m + 1) for j in range(1, 7))
    lanes = []
    for a, start in noise.LANES:
        chain = _mix_chain(start, a, [f"PATID % {noise.P}", f"PATID // {noise.P}", "key", "1"])
        lanes.append(f"(({chain}) % {noise.P} + 0.5e0) / {noise.P}e0")
    fits = ", ".join(
        f"f{t} AS (SELECT regr_slope(bprs{t}, bprs{t-1}) AS b, regr_intercept(bprs{t}, bprs{t-1}) AS a, "
        f"sqrt((regr_syy(bprs{t}, bprs{t-1}) - regr_slope(bprs{t}, bprs{t-1}) * regr_sxy(bprs{t}, bprs{t-1})) "
        f"/ (regr_count(bprs{t}, bprs{t-1}) - 2)) AS s FROM mono)" for t in range(1, 7))
    sc = ", ".join(f"('{n}', {s}e0)" for n, s in shifts)
    steps = [f"u0 AS (SELECT scenario, shift, imp, PATID, bprs0 AS v0, {', '.join(f'bprs{t}' for t in range(1, 7))} "
             f"FROM mono, (SELECT unnest(range(1, {m + 1})) AS imp), (VALUES {sc}) AS s(scenario, shift))"]
    for t in range(1, 7):
        prev = ", ".join(f"v{k}" for k in range(t))
        rest = ", ".join(f"bprs{k}" for k in range(t + 1, 7))
        steps.append(
            f"u{t} AS (SELECT scenario, shift, u.imp, u.PATID, {prev}, coalesce(bprs{t}, a + b * v{t-1} + shift + s * z) "
            f"AS v{t}{', ' + rest if rest else ''} FROM u{t-1} u CROSS JOIN f{t} "
            f"JOIN zz ON zz.PATID = u.PATID AND zz.imp = u.imp AND zz.j = {t})")
    final = ("plug AS (SELECT scenario, imp, PATID, " + ", ".join(f"v{t} AS bprs{t}" for t in V) + " FROM u6)")
    pl = ("plong AS (SELECT scenario, imp, PATID, unnest(range(7)) AS TIME, unnest(["
          + ", ".join(f"bprs{t}" for t in V) + "]) AS bprs FROM plug)")
    lines = """ln_ AS (SELECT scenario, imp, regr_slope(bprs, TIME) AS b, regr_intercept(bprs, TIME) AS a, count(*) AS n,
      regr_sxx(bprs, TIME) AS sxx, avg(TIME) AS tm,
      (regr_syy(bprs, TIME) - regr_slope(bprs, TIME) * regr_sxy(bprs, TIME)) / (count(*) - 2) AS s2
      FROM plong GROUP BY ALL),
    pp AS (SELECT scenario, imp, 'TIME' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error FROM ln_ UNION ALL
      SELECT scenario, imp, 'Intercept', a, sqrt(s2 * (1e0 / n + tm * tm / sxx)) FROM ln_),
    pq AS (SELECT *, within + (1 + 1e0 / m) * between_ AS total FROM (SELECT scenario, term, count(*) AS m,
      avg(estimate) AS estimate, avg(std_error * std_error) AS within, var_samp(estimate) AS between_ FROM pp GROUP BY ALL))"""
    return [f"kk(imp, j, key) AS (VALUES {keys})",
            f"uu AS (SELECT PATID, imp, j, {lanes[0]} AS a1, {lanes[1]} AS a2 FROM mono, kk)",
            "zz AS (SELECT PATID, imp, j, sqrt(-2 * ln(a1)) * cos(2 * pi() * a2) AS z FROM uu)",
            fits, *steps, final, pl, lines]


PLUG = plugin_ctes()
PLUG_SHIFT = plugin_ctes(shifts=tuple((f"SHIFT_{s}", float(s)) for s in (0, 4, 8)))


def cols(names, d=6):
    return ", ".join(f"{R(n, d)} AS {n}" for n in names)


def _stats(table, by=""):
    g = f"{by}, " if by else ""
    return (f"SELECT {g}avg(AGE) AS mean_AGE, stddev_samp(AGE) AS sd_AGE, avg(BMI) AS mean_BMI, stddev_samp(BMI) AS sd_BMI "
            f"FROM {table}" + (f" GROUP BY {by}" if by else ""))


def _bins(fam, cut, op):
    return ", ".join(f"CASE WHEN {fam}{t} IS NULL THEN NULL WHEN {fam}{t} {op} {cut} THEN 0 ELSE 1 END AS {fam}_bin{t}"
                     for t in V)


PATTERN = "concat(" + ", ".join(f"CASE WHEN cdrsb{t} IS NULL THEN '0' ELSE '1' END" for t in V) + ")"
FIRST = "coalesce(CAST(least(" + ", ".join(f"CASE WHEN cdrsb{t} IS NULL THEN {t} END" for t in V) + ") AS VARCHAR), 'Complete')"
LAST = "greatest(" + ", ".join(f"CASE WHEN cdrsb{t} IS NOT NULL THEN {t} END" for t in V) + ")"
EDU = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CELL = "printf('%.3f (sd=%.3f)', estimate, std_error)"
SURE = "(CASE WHEN cdrsb >= 10 THEN 1e0 ELSE 0e0 END)"


def _audit(fam_cols, m):
    body = " UNION ALL ".join(
        f"SELECT imp, '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_imputed, 0 AS n_left, 0 AS n_changed, "
        f"round(avg({c}), 6) AS mean_observed FROM panel, (SELECT unnest(range(1, {m + 1})) AS imp) GROUP BY imp"
        for c in fam_cols)
    return q(body)


def _corr(names, source):
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS row_var, '{b}' AS col_var, round(corr({a}, {b}), 2) + 0e0 AS corr FROM z"
                               for a in names for b in names)
    return q(pairs, f"z AS ({source})")


_LEVELS = {"TRIAL": "SELECT DISTINCT 'TRIAL' AS f, CAST(TRIAL AS VARCHAR) AS lv FROM panel", "SEX": "SELECT DISTINCT 'SEX', CAST(SEX AS VARCHAR) FROM panel", "EDU": "SELECT DISTINCT 'EDU', EDU FROM panel",
           "JOB": "SELECT DISTINCT 'JOB', CAST(JOB AS VARCHAR) FROM panel", "WZC": "SELECT DISTINCT 'WZC', CAST(WZC AS VARCHAR) FROM panel"}


def _zero_scores(numbers, classes, rows, dropped):
    """Every term with a score of zero, class levels from the table but the `dropped` (min or max) one."""
    lv = " UNION ALL ".join(_LEVELS[c] for c in classes)
    return q(f"SELECT term, 0e0 AS score, n AS n_rows FROM (SELECT f || '[' || lv || ']' AS term FROM (SELECT *, {dropped}(lv) OVER (PARTITION BY f) AS base FROM lv) WHERE lv <> base "
             f"UNION ALL SELECT unnest({numbers!r})), (SELECT count(*) AS n FROM {rows})", f"lv(f, lv) AS ({lv})")


SQL = {
    "panel_wide": q(f"SELECT PATID, TRIAL, SEX, {R('AGE')} AS AGE, EDU, {R('BMI')} AS BMI, {R('INKOMEN')} AS INKOMEN, JOB, ADL, WZC, "
                    f"{cols(ALLV)} FROM panel"),
    "panel_monotone": q(f"SELECT PATID, {cols(ALLV)} FROM mono"),
    "wide_to_long": q(f"SELECT PATID, SEX, {R('AGE')} AS AGE, TIME, {cols(FAMS)} FROM long"),
    "pivot_longer_by_name": q(f'SELECT PATID, TIME AS "time", {cols(["cdrsb", "bprs"])} FROM long'),
    "complete_case_visits": q(f"SELECT PATID, TIME, CAST(TIME AS VARCHAR) AS timeclss, cdrsb_cat, {cols(FAMS)} FROM cc"),
    "response_indicator": q("SELECT PATID, TIME, CASE WHEN cdrsb IS NULL THEN 0 ELSE 1 END AS R, CASE WHEN cdrsb IS NULL THEN NULL "
                            "WHEN cdrsb < 10 THEN 0 ELSE 1 END AS cdrsb_cat FROM long"),
    "binarize_closed_right": q(f"SELECT PATID, {_bins('cdrsb', 10, '<')} FROM panel"),
    "binarize_closed_left": q(f"SELECT PATID, {_bins('taupet', 2, '<=')} FROM panel"),
    "keep_drop_rename": q("SELECT PATID, " + ", ".join(f"{R(f'bprs{t}')} AS o_B{t}" for t in range(1, 7)) + " FROM panel"),
    "select_by_pattern": q(f"SELECT PATID, {cols(CDRSB)} FROM panel"),
    "baseline_copy": q(f"SELECT PATID, {R('abpet0')} AS ab_base, {R('taupet0')} AS tau_base, {R('cdrsb0')} AS cdrsb_base, "
                       f"{R('bprs0')} AS bprs_base FROM panel"),
    "factor_code_adl": q("SELECT PATID, ADL, dense_rank() OVER (ORDER BY ADL) AS adl_num FROM panel"),
    "class_design_columns": q("SELECT PATID, " + ", ".join(f"CASE WHEN EDU = '{e}' THEN 1e0 ELSE 0e0 END AS edu_{e.lower()}" for e in EDU[1:])
                              + ", CASE WHEN SEX = 1 THEN 1e0 ELSE 0e0 END AS sex_1 FROM panel"),
    "class_design_effect_coding": q("SELECT PATID, " + ", ".join(
        f"CASE WHEN EDU = '{e}' THEN 1e0 WHEN EDU = 'MACHINERY' THEN -1e0 ELSE 0e0 END AS edu_{e.lower()}" for e in EDU[:-1]) + " FROM panel"),
    "observed_visit_count": q("SELECT PATID, count(bprs) AS n_obs_data FROM long GROUP BY PATID"),
    "last_visit_rows": q(f"SELECT PATID, TIME, {cols(FAMS)} FROM long WHERE TIME = 6"),
    "delete_unobserved": q("SELECT PATID, TIME, c AS cdrsb_cat, CASE WHEN TIME = 0 THEN 0 ELSE pv END AS prev_resp FROM (SELECT *, "
                           "CASE WHEN cdrsb IS NULL THEN NULL WHEN cdrsb < 10 THEN 0 ELSE 1 END AS c, lag(c) OVER (PARTITION BY PATID ORDER BY TIME) AS pv "
                           "FROM long) WHERE cdrsb IS NOT NULL"),
    "parameters_transposed": q("SELECT imp, " + ", ".join(
        f"{R(f'max(estimate) FILTER (WHERE term = {chr(39)}{f}{chr(39)})', 6)} AS {f}, "
        f"{R(f'max(std_error) FILTER (WHERE term = {chr(39)}{f}{chr(39)})', 6)} AS SE_{f}" for f in FAMS) + " FROM rp GROUP BY imp"),
    "parameters_by_scenario": q("SELECT term, " + ", ".join(f"max({CELL}) FILTER (WHERE imp = {i}) AS REGION_{i}" for i in range(1, 6))
                                + " FROM rp GROUP BY term"),
    "evaluation_grid": q(f"SELECT time_tenths, {R('TIME')} AS TIME, {R('m * TIME')} AS line FROM grid, (SELECT avg(bprs0) AS m FROM panel)"),
    "expand_imputations": q("SELECT imp, count(*) AS n, round(avg(bprs0), 6) AS mean_bprs0 FROM panel, (SELECT unnest([1, 2, 3]) AS imp) GROUP BY imp"),
    "statistics_to_every_row": q(f"SELECT PATID, {R('(AGE - mean_AGE) / sd_AGE')} AS AGE_STD, {R('(BMI - mean_BMI) / sd_BMI')} AS BMI_STD FROM panel, st",
                                 f"st AS ({_stats('panel')})"),
    "statistics_by_group": q(f"SELECT PATID, EDU, {R('(AGE - mean_AGE) / sd_AGE')} AS AGE_STD, {R('(BMI - mean_BMI) / sd_BMI')} AS BMI_STD FROM panel JOIN st USING (EDU)",
                             f"st AS ({_stats('panel', 'EDU')})"),
    "zscore_scope_reference": q(f"SELECT PATID, TIME, {R('(AGE - mean_AGE) / sd_AGE')} AS AGE_STD, {R('(BMI - mean_BMI) / sd_BMI')} AS BMI_STD, "
                                f"{R('(abpet - ma) / sa')} AS abpet_STD, {R('(taupet - mt) / s_t')} AS taupet_STD FROM cc, st, bs",
                                f"st AS ({_stats('panel')})",
                                "bs AS (SELECT avg(abpet) AS ma, stddev_samp(abpet) AS sa, avg(taupet) AS mt, stddev_samp(taupet) AS s_t FROM cc)"),
    "original_values_joined": q("SELECT imp, PATID, " + ", ".join(f"{R(f'coalesce({c}, 0)')} AS {c}, {R(c)} AS o_{c}" for c in ("bprs1", "bprs2"))
                                + " FROM panel, (SELECT unnest([1, 2]) AS imp)"),
    "pattern_label_joined": q(f"SELECT PATID, TIME, {R('long.cdrsb')} AS cdrsb, first_missing FROM long JOIN (SELECT PATID, {FIRST} AS first_missing FROM panel) USING (PATID)"),
    "membership_flag": q("SELECT PATID, CASE WHEN cdrsb6 IS NOT NULL THEN 'Completer' ELSE 'Dropout' END AS status FROM panel"),
    "keep_sampled_members": q(f"SELECT PATID, TIME, {cols(FAMS)} FROM long WHERE PATID IN (SELECT PATID FROM panel WHERE cdrsb6 IS NOT NULL)"),
    "merge_curves_by_time": q(f"SELECT grid.time_tenths, {R('p')} AS prop_observed, {R('m + grid.TIME')} AS line FROM grid CROSS JOIN (SELECT avg(AGE) AS m FROM panel) "
                              "LEFT JOIN (SELECT TIME * 10 AS k, avg(cdrsb_cat) AS p FROM cc GROUP BY TIME) ON k = time_tenths"),
    "merge_parameter_tables": q(f"SELECT imp, {R('estimate', 6)} AS estimate, {R('std_error', 6)} AS std_error FROM rp WHERE term = 'bprs'"),
    "global_mean_sd": q(f"SELECT {cols(['mean_AGE', 'sd_AGE', 'mean_BMI', 'sd_BMI'])} FROM ({_stats('panel')})"),
    "grouped_mean_sd": q(f"SELECT TRIAL, {cols(['mean_AGE', 'sd_AGE', 'mean_BMI', 'sd_BMI'])} FROM ({_stats('panel', 'TRIAL')})"),
    "mean_variance_count_by_class": q(f"SELECT term, {R('avg(estimate)', 8)} AS mean, {R('var_samp(estimate)', 8)} AS variance, count(*) AS n FROM rp GROUP BY term"),
    "missing_report": q(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS nmiss, {R(f'CAST(min({c}) AS DOUBLE)')} AS \"min\" FROM long"
                                           for c in ("TIME", "SEX", "BMI", "ADL", "cdrsb", "bprs"))),
    "frequency_of_response": q("SELECT CASE WHEN cdrsb IS NULL THEN 0 ELSE 1 END AS R, count(*) AS n FROM long GROUP BY 1"),
    "mean_by_visit": q(f"SELECT TIME, {R('avg(cdrsb_cat)')} AS mean_cat FROM cc GROUP BY TIME"),
    "dropout_by_visit": q("SELECT TIME, count(*) AS n_total, count(cdrsb) AS observed, count(*) - count(cdrsb) AS missing, "
                          "round((count(*) - count(cdrsb)) * 100e0 / count(*), 2) AS pct_missing FROM long GROUP BY TIME"),
    "missing_by_variable": q(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_miss, {R(f'(count(*) - count({c})) * 100e0 / count(*)')} AS pct_missing FROM long"
                                                for c in FAMS)),
    "missing_by_group": q(" UNION ALL ".join(
        f"SELECT '{f}' AS factor, CAST({e} AS VARCHAR) AS level, max(count(*)) OVER (PARTITION BY {e}) AS n, '{c}' AS variable, "
        f"{R(f'(count(*) - count({c})) * 100e0 / count(*)')} AS pct_missing FROM panel GROUP BY {e}"
        for f in PANEL.covariates for e in [f"CAST(floor({f}) AS BIGINT)" if f in ("AGE", "BMI", "INKOMEN") else f] for c in CDRSB)),
    "missing_cells": q("SELECT PATID, " + ", ".join(f"{c} IS NULL AS {c}" for c in CDRSB) + " FROM panel"),
    "missing_share": q(f"SELECT count(*) // 7 AS n_rows, 4 * (count(*) - count(cdrsb)) AS n_missing, {R('(count(*) - count(cdrsb)) * 100e0 / count(*)')} AS pct_missing FROM long"),
    "subject_patterns": q(f"SELECT PATID, {PATTERN} AS pattern, " + " + ".join(f"CASE WHEN cdrsb{t} IS NULL THEN 0 ELSE {1 << t} END" for t in V) + " AS mask FROM panel"),
    "missing_patterns": q(f"SELECT {PATTERN} AS pattern, count(*) AS n FROM panel GROUP BY 1"),
    "monotone_check": q(" UNION ALL ".join(f"SELECT bool_and(NOT contains({PATTERN}, '01')) AS monotone, count(*) FILTER (WHERE contains({PATTERN}, '01')) AS n_intermittent, "
                                           f"'{v}' AS variant FROM {t}" for v, t in (("panel", "panel"), ("monotone", "mono")))),
    "dropout_and_last_visit": q(f"SELECT PATID, {FIRST} AS first_missing, {LAST} AS last_observed FROM panel"),
    "mean_profile_by_dropout": q("SELECT TIME, first_missing, " + ", ".join(f"{R(f'avg(mlong.{f})')} AS mean_{f}" for f in FAMS)
                                 + f" FROM mlong JOIN (SELECT PATID, {FIRST} AS first_missing FROM mono) USING (PATID) GROUP BY ALL"),
    "baseline_compare": q("SELECT CASE WHEN cdrsb6 IS NOT NULL THEN 'Completer' ELSE 'Dropout' END AS status, count(*) AS n, " + ", ".join(
        f"{R(f'avg({c})')} AS {a}" for a, c in (("cdrsb_base_mean", "cdrsb0"), ("bprs_base_mean", "bprs0"), ("taupet_base_mean", "taupet0"),
                                               ("abpet_base_mean", "abpet0"), ("sex_mean", "SEX"), ("age_mean", "AGE"), ("bmi_mean", "BMI"), ("inkomen_mean", "INKOMEN"),
                                               ("job_mean", "JOB"), ("adl_mean", "code"), ("wzc_mean", "WZC")))
                          + " FROM (SELECT *, dense_rank() OVER (ORDER BY ADL) AS code FROM panel) GROUP BY 1"),
    "box_summary": q(f"SELECT x.TIME, x.is_missing_next, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, count(*) AS n, "
                     f"{R('min(bprs) FILTER (WHERE bprs >= q1 - 1.5e0 * (q3 - q1))')} AS whisker_low, {R('max(bprs) FILTER (WHERE bprs <= q3 + 1.5e0 * (q3 - q1))')} AS whisker_high, "
                     "count(*) FILTER (WHERE bprs < q1 - 1.5e0 * (q3 - q1) OR bprs > q3 + 1.5e0 * (q3 - q1)) AS n_outliers FROM x JOIN g ON g.TIME = x.TIME AND "
                     "g.is_missing_next = x.is_missing_next WHERE bprs IS NOT NULL GROUP BY ALL",
                     "x AS (SELECT PATID, TIME, bprs, nx IS NULL AS is_missing_next FROM (SELECT *, lead(cdrsb) OVER (PARTITION BY PATID ORDER BY TIME) AS nx FROM long) WHERE TIME < 6)",
                     "g AS (SELECT TIME, is_missing_next, quantile_cont(bprs, 0.25) AS q1, quantile_cont(bprs, 0.5) AS median, quantile_cont(bprs, 0.75) AS q3 FROM x GROUP BY ALL)"),
    "correlation_matrix": _corr(BPRS, "SELECT * FROM ccw"),
    "correlation_of_bins": _corr([f"cdrsb_bin{t}" for t in V], f"SELECT {_bins('cdrsb', 10, '<=')} FROM ccw"),
    "bar_counts": q("SELECT TIME, CASE WHEN cdrsb IS NULL THEN NULL WHEN cdrsb <= 10 THEN 0 ELSE 1 END AS cdrsb_bin, count(*) AS n FROM long GROUP BY ALL"),
    "histogram_by_visit": q("SELECT TIME, floor(bprs + 0.5e0) AS bin_centre, count(*) AS n FROM cc GROUP BY ALL"),
    "sampled_mean_trend": q(f"SELECT TIME, {R('avg(cdrsb)')} AS mean_cdrsb FROM long WHERE PATID IN (SELECT PATID FROM panel ORDER BY md5('123|' || CAST(PATID AS VARCHAR)) LIMIT 30) GROUP BY TIME"),
    "observed_proportion": q(f"SELECT TIME, {R('avg(cdrsb_cat)', 6)} AS prop_observed FROM cc GROUP BY TIME"),
    "previous_values": q("SELECT * FROM (SELECT PATID, TIME, " + ", ".join(f"{R(f'lag({f}) OVER (PARTITION BY PATID ORDER BY TIME)')} AS prev_{f}" for f in FAMS) + " FROM long) WHERE TIME > 0"),
    "dropout_model_rows": q("SELECT * FROM (SELECT PATID, TIME, CAST(cdrsb IS NULL AS INTEGER) AS is_missing, " + ", ".join(
        f"{R(f'lag({f}) OVER (PARTITION BY PATID ORDER BY TIME)')} AS prev_{f}" for f in FAMS) + " FROM long) WHERE TIME > 0"),
    "previous_response": q("SELECT PATID, TIME, CASE WHEN cdrsb IS NULL THEN 0 ELSE 1 END AS R, CASE WHEN TIME = 0 THEN 0 ELSE lag(CASE WHEN cdrsb IS NULL THEN NULL WHEN cdrsb < 10 "
                           "THEN 0 ELSE 1 END) OVER (PARTITION BY PATID ORDER BY TIME) END AS prev_resp FROM long"),
    "missing_at_next_visit": q("SELECT * FROM (SELECT PATID, TIME, lead(cdrsb IS NULL) OVER (PARTITION BY PATID ORDER BY TIME) AS is_missing_next FROM long) WHERE TIME < 6"),
    "first_row_flag": q("SELECT PATID, TIME, CASE WHEN row_number() OVER (PARTITION BY PATID ORDER BY TIME) = 1 THEN 1 ELSE 0 END AS is_first FROM cc"),
    "running_product": q(f"SELECT PATID, TIME, {R('exp(sum(coalesce(ln(abpet), 0)) OVER (PARTITION BY PATID ORDER BY TIME))')} AS product FROM long"),
    "person_period": q(f"SELECT PATID, TIME, R, {R('prev')} AS CDRSB_PREV FROM risk"),
    "shift_time_and_rejoin": q(f"SELECT cc.PATID, cc.TIME, {R('cdrsb')} AS cdrsb, {R('prev')} AS CDRSB_PREV FROM cc LEFT JOIN risk ON risk.PATID = cc.PATID AND risk.TIME + 1 = cc.TIME"),
    "grouped_standardise": q(f"SELECT PATID, TIME, {R('(bprs - avg(bprs) OVER (PARTITION BY TIME)) / stddev_samp(bprs) OVER (PARTITION BY TIME)')} AS bprs_std FROM cc"),
    "sorted_first_rows": q(f"SELECT PATID, TIME, {cols(FAMS)} FROM (SELECT * FROM long ORDER BY PATID, TIME LIMIT 6)"),
    "sample_subjects": q("SELECT PATID FROM panel ORDER BY md5('123|' || CAST(PATID AS VARCHAR)) LIMIT 30"),
    "stacked_tables": q(f"SELECT TIME, {R('avg(cdrsb_cat)')} AS prop_observed, 'observed' AS source, NULL::DOUBLE AS mean_bprs FROM cc GROUP BY TIME UNION ALL "
                        f"SELECT TIME, NULL, 'means', {R('avg(bprs)')} FROM cc GROUP BY TIME"),
    "scalar_text": q(f"SELECT imp, term, upper(replace(replace('time *' || term, '*', '_'), ' ', '')) AS var_name, 'STD_Shift_' || imp AS scenario, {CELL} AS cell FROM rp"),
    "scalar_arithmetic": q(f"SELECT PATID, TIME, {R('p')} AS p, {R('1 / p')} AS weight, {R('p * (1 - p)')} AS variance, CAST(TIME * TIME AS DOUBLE) AS time_sq, "
                           f"{R('exp(-abpet)')} AS decay FROM (SELECT *, 1 / (1 + exp(-(bprs / 10e0 - 2))) AS p FROM cc)"),
    "array_positions": q(f"SELECT PATID, {R('bprs2', 3)} AS bprs_at_2, {R(' + '.join(f'coalesce(bprs{t} - cdrsb{t}, 0)' for t in V), 3)} AS total_gap FROM panel"),
    "linear_predictor_on_grid": q(f"SELECT time_tenths, {R('1 / (1 + exp(-(b0 / 100e0 + b1 * TIME + 0.1e0 * TIME)))', 6)} AS pred_prob FROM grid, "
                                  "(SELECT avg(AGE) AS b0, regr_slope(bprs1, bprs0) AS b1 FROM panel)"),
    # Closed forms of models.
    "dropout_model_one_factor": q(
        f"SELECT 'Intercept' AS term, {R4('ln(a0 / b0)')} AS estimate, {R4('sqrt(1 / a0 + 1 / b0)')} AS std_error, {R4('ln(a0 / b0) / sqrt(1 / a0 + 1 / b0)')} AS z_value, n AS n_rows FROM t UNION ALL "
        f"SELECT 'SEX', {R4('ln(a1 / b1) - ln(a0 / b0)')}, {R4('sqrt(1 / a0 + 1 / b0 + 1 / a1 + 1 / b1)')}, {R4('(ln(a1 / b1) - ln(a0 / b0)) / sqrt(1 / a0 + 1 / b0 + 1 / a1 + 1 / b1)')}, n FROM t",
        "t AS (SELECT count(*) AS n, " + ", ".join(f"CAST(count(*) FILTER (WHERE SEX = {s} AND cdrsb IS {x} NULL) AS DOUBLE) AS {a}{s}"
                                                   for s in (0, 1) for a, x in (("a", ""), ("b", "NOT"))) + " FROM long WHERE TIME > 0)"),
    "observation_probability_by_sex": q(f"SELECT PATID, TIME, R, {R4('p')} AS prob_obs FROM risk JOIN psex USING (SEX)"),
    "little_mcar_two_visits": q(
        f"SELECT {R4('n1 * (g1 * g1 * s22 - 2 * g1 * g2 * s12 + g2 * g2 * s11) / (s11 * s22 - s12 * s12) + n2 * g3 * g3 / s11')} AS statistic, 1 AS df, 2 AS n_patterns FROM "
        "(SELECT *, x1 - m1 AS g1, y1 - m2 AS g2, x2 - m1 AS g3 FROM (SELECT *, y1 + b * (m1 - x1) AS m2, b * s11 AS s12, syx + b * b * s11 AS s22 FROM f))",
        "f AS (SELECT count(*) AS n, avg(bprs0) AS m1, var_pop(bprs0) AS s11, count(bprs1) AS n1, count(*) - count(bprs1) AS n2, "
        "avg(bprs0) FILTER (WHERE bprs1 IS NOT NULL) AS x1, avg(bprs0) FILTER (WHERE bprs1 IS NULL) AS x2, avg(bprs1) AS y1, regr_slope(bprs1, bprs0) AS b, "
        "(regr_syy(bprs1, bprs0) - regr_slope(bprs1, bprs0) * regr_sxy(bprs1, bprs0)) / count(bprs1) AS syx FROM mono)"),
    "ipw_cumulative_by_sex": q(f"SELECT PATID, TIME, {R4('prob_obs')} AS prob_obs, {R4('W')} AS W FROM cumw"),
    "ipw_point_shifted_by_sex": q(f"SELECT PATID, TIME, {R4('prob_obs')} AS prob_obs, {R4('CASE WHEN TIME = 0 THEN 1e0 ELSE 1 / prob_obs END')} AS W FROM wts"),
    "ipw_visit_by_sex": q(f"SELECT PATID, TIME, {R4('prob_obs')} AS prob_obs, {R4('W')} AS W FROM visitw"),
    "weights_joined_to_panel": q(f"SELECT PATID, TIME, {R('cdrsb')} AS cdrsb, {R4('W')} AS W FROM cumw"),
    "audit_fcs": _audit(BPRS, 10),
    "audit_mvn": _audit(CDRSB, 10),
    "audit_whole_number_gaps": q(" UNION ALL ".join(
        f"SELECT '{meth}' AS method, imp, '{c}' AS variable, count(*) AS n, count(*) FILTER (PATID % {k} = 0) AS n_imputed, 0 AS n_left, 0 AS n_changed, "
        f"round(avg({c}) FILTER (PATID % {k} <> 0), 6) AS mean_observed FROM panel, (SELECT unnest(range(1, 11)) AS imp) GROUP BY imp"
        for meth, gaps in (("mvn", {"JOB": 5, "ADL": 7, "WZC": 6}), ("fcs", {"JOB": 5, "ADL": 7, "WZC": 6}), ("monotone", {"ADL": 7})) for c, k in gaps.items())),
    "audit_many_patterns": q(" UNION ALL ".join(
        f"SELECT imp, '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_imputed, 0 AS n_left, 0 AS n_changed, "
        f"round(avg({c}), 6) AS mean_observed FROM holes, (SELECT unnest([1, 2]) AS imp) GROUP BY imp" for c in ALLV),
        "holes AS (SELECT " + ", ".join(f"CASE WHEN (PATID * {2 * i + 3} + {i * i}) % {7 + i} <> 0 THEN {c} END AS {c}" for i, c in enumerate(ALLV)) + " FROM panel)"),
    "audit_many_patterns_chained": q(" UNION ALL ".join(
        f"SELECT scenario, imp, '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_imputed, 0 AS n_left, 0 AS n_changed, "
        f"round(avg({c}), 6) AS mean_observed FROM holes, (SELECT unnest([1, 2]) AS imp), (SELECT unnest(['PLAIN', 'UP']) AS scenario) GROUP BY scenario, imp" for c in BPRS),
        "holes AS (SELECT " + ", ".join(f"CASE WHEN (PATID * {2 * i + 3} + {i * i}) % {7 + i} <> 0 THEN {c} END AS {c}" for i, c in enumerate(BPRS)) + " FROM panel)"),
    "audit_past_only": q(" UNION ALL ".join(
        f"SELECT method, imp, '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_imputed, 0 AS n_left, 0 AS n_changed, round(avg({c}), 6) AS mean_observed "
        "FROM panel, (SELECT unnest(range(1, 6)) AS imp), (SELECT unnest(['mice_ncmv', 'mice_shift']) AS method) GROUP BY method, imp" for c in BPRS)),
    "audit_class_variables": q(" UNION ALL ".join(
        f"SELECT imp, '{c}' AS variable, count(*) AS n, count(*) FILTER ({g}) AS n_imputed, 0 AS n_left, 0 AS n_changed FROM panel, (SELECT unnest(range(1, 6)) AS imp) GROUP BY imp"
        for c, g in (("EDU", "PATID % 5 = 0"), ("WZC", "PATID % 7 = 0"), *((b, f"{b} IS NULL") for b in BPRS)))),
    "donors_of_whole_frame": q(" UNION ALL ".join(
        f"SELECT scenario, '{c}' AS variable, count(*) AS n, 0 AS n_strange FROM panel, (SELECT unnest(['S0', 'S4']) AS scenario) GROUP BY scenario" for c in [*ALLV] if c[:-1] != "bprs" or c == "bprs0")),
    "shift_after_imputation_moves": q(" UNION ALL ".join(
        f"SELECT imp, '{c}' AS variable, count(*) AS n, {f'count(*) - count({c})' if c != 'bprs0' else '0'} AS n_moved, {f'5e0 * (count(*) - count({c}))' if c != 'bprs0' else '0e0'} AS moved "
        "FROM mono, (SELECT unnest(range(1, 5)) AS imp) GROUP BY imp" for c in BPRS)),
    "imputed_long_counts": q("SELECT imp, TIME, count(*) AS n FROM mono, (SELECT unnest(range(1, 5)) AS imp), (SELECT unnest(range(7)) AS TIME) GROUP BY imp, TIME"),
    "scenario_rounding": q("SELECT scenario, count(*) AS n, scenario = 'ROUNDED' AS all_round FROM mono, (SELECT unnest(range(1, 5)) AS imp), "
                           "(SELECT unnest(['PLAIN', 'ROUNDED']) AS scenario) GROUP BY scenario"),
    "audit_donor_matching": _audit(CDRSB[:3], 2),
    "donor_values_are_observed": q("SELECT imp, count(*) AS n, 0 AS n_strange FROM panel, (SELECT unnest([1, 2]) AS imp) GROUP BY imp"),
    "impute_monotone_plugin": q(f"SELECT imp, PATID, {cols(BPRS)} FROM plug", *PLUG),
    "impute_plugin_rounded": q("SELECT imp, count(*) AS n, 0 AS n_unrounded FROM mono, (SELECT unnest(range(1, 5)) AS imp) GROUP BY imp"),
    "shift_inside_chain": q(f"SELECT scenario, imp, PATID, {cols(BPRS)} FROM plug", *PLUG_SHIFT),
    "shift_after_imputation": q(f"SELECT imp, PATID, {R('plug.bprs0')} AS bprs0, " + ", ".join(
        f"{R(f'plug.bprs{t} + CASE WHEN mono.bprs{t} IS NULL THEN 5 ELSE 0 END')} AS bprs{t}" for t in range(1, 7)) + " FROM plug JOIN mono USING (PATID)", *PLUG),
    "imputed_long_rows": q(f"SELECT imp, PATID, TIME, {R('bprs')} AS bprs FROM plong", *PLUG),
    "imputed_proportion": q(f"SELECT TIME, {R('avg(CASE WHEN bprs < 25 THEN 0 ELSE 1 END)')} AS prop_imputed FROM plong GROUP BY TIME", *PLUG),
    "ols_line": q(f"SELECT 'Intercept' AS term, {R('a')} AS estimate, {R('sqrt(s2 * (1e0 / n + tm * tm / sxx))')} AS std_error, {R('a / sqrt(s2 * (1e0 / n + tm * tm / sxx))')} AS t_value FROM x UNION ALL "
                  f"SELECT 'TIME', {R('b')}, {R('sqrt(s2 / sxx)')}, {R('b / sqrt(s2 / sxx)')} FROM x", "x AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM line)"),
    "ols_residuals_primary": q("SELECT n, term, 0e0 AS residual_sum FROM (SELECT count(*) AS n FROM long JOIN panel USING (PATID) WHERE long.bprs IS NOT NULL AND panel.cdrsb0 IS NOT NULL), "
                               "(SELECT unnest(['Intercept', 'TIME', 'AGE', 'BMI', 'ADL', 'cdrsb0', 'TIME*cdrsb0']) AS term)"),
    "ols_residuals": q(f"SELECT PATID, TIME, {R('bprs - a - b * TIME')} AS residual FROM cc, line"),
    "empirical_variance": q(f"SELECT TIME, {R('empirical_variance')} AS empirical_variance FROM ev"),
    "lmm_balanced": q(f"SELECT 'Intercept' AS term, {R('m0', 3)} AS estimate, {R('sqrt(v00 / n)', 3)} AS std_error FROM bal UNION ALL SELECT 'TIME', {R('m1', 3)}, {R('sqrt(v11 / n)', 3)} FROM bal"),
    "lmm_balanced_covariance": q(" UNION ALL ".join(f"SELECT '{n}' AS cov_parm, {R(c, 2)} AS estimate FROM bal"
                                                    for n, c in (("UN(1,1)", "d11"), ("UN(2,1)", "d12"), ("UN(2,2)", "d22"), ("Residual", "s2")))),
    "lmm_balanced_effects": q(
        f"SELECT PATID, {R('d11 * w0 + d12 * w1', 2)} AS intercept_effect, {R('d12 * w0 + d22 * w1', 2)} AS slope_effect FROM (SELECT *, "
        "(v11 * (b0 - m0) - v01 * (b1 - m1)) / (v00 * v11 - v01 * v01) AS w0, (v00 * (b1 - m1) - v01 * (b0 - m0)) / (v00 * v11 - v01 * v01) AS w1 FROM sub, bal)"),
    "gee_complete_saturated": q(f"SELECT 'VISIT' || TIME || '_' AS term, {R4('ln(p / (1 - p))')} AS estimate, {R4('1 / sqrt(n * p * (1 - p))')} AS std_error FROM "
                                f"(SELECT TIME, count(*) AS n, avg({SURE}) AS p FROM cc WHERE PATID IN (SELECT PATID FROM ccw) GROUP BY TIME)"),
    "gee_complete_correlation": q(
        f"SELECT a.TIME AS row_visit, b.TIME AS col_visit, {R4('CASE WHEN a.TIME = b.TIME THEN 1e0 ELSE sum(a.e * b.e) / ((count(*) - 7) * (7e0 * count(*) / (7 * count(*) - 7))) END')} AS corr "
        "FROM e a JOIN e b USING (PATID) GROUP BY a.TIME, b.TIME",
        f"e AS (SELECT PATID, TIME, (y - p) / sqrt(p * (1 - p)) AS e FROM (SELECT PATID, TIME, {SURE} AS y, avg({SURE}) OVER (PARTITION BY TIME) AS p FROM cc "
        "WHERE PATID IN (SELECT PATID FROM ccw)))"),
    "gee_weighted_saturated": q(
        f"SELECT 'VISIT' || TIME || '_' AS term, {R4('ln(p / (1 - p))')} AS estimate, {R4('sqrt(sum(W * W * (y - p) * (y - p))) / sum(W * p * (1 - p))')} AS std_error FROM "
        f"(SELECT *, sum(W * y) OVER (PARTITION BY TIME) / sum(W) OVER (PARTITION BY TIME) AS p FROM (SELECT *, {SURE} AS y FROM visitw)) GROUP BY TIME, p"),
    "pool_rubin": q(f"SELECT term, m, {R('estimate', 5)} AS estimate, {R('within', 5)} AS within, {R('between_', 5)} AS \"between\", {R('total', 5)} AS total, {R('sqrt(total)', 5)} AS std_error, "
                    f"{R('(m - 1) / pow((1 + 1e0 / m) * between_ / total, 2)', 5)} AS df, {R('estimate / sqrt(total)', 5)} AS t_value, {R('(1 + 1e0 / m) * between_ / within', 5)} AS rel_increase, "
                    f"{R('(1 + 1e0 / m) * between_ / total', 5)} AS fraction_missing FROM pooled"),
    "pool_barnard_rubin": q(f"SELECT term, m, {R('estimate')} AS estimate, {R('sqrt(total)')} AS std_error, {R('o * s / (o + s)')} AS df FROM (SELECT *, (m - 1) / (l * l) AS o, "
                            "1001e0 / 1003e0 * 1000 * (1 - l) AS s FROM (SELECT *, (1 + 1e0 / m) * between_ / total AS l FROM pooled))"),
    "pool_wide_input": q(f"SELECT term, m, {R('estimate', 5)} AS estimate, {R('total', 5)} AS total, {R('(m - 1) / pow((1 + 1e0 / m) * between_ / total, 2)', 5)} AS df FROM pooled"),
    "impute_fit_pool": q(f"SELECT term, m, {R('estimate')} AS estimate, {R('within')} AS within, {R('between_')} AS \"between\", {R('total')} AS total, {R('sqrt(total)')} AS std_error FROM pq", *PLUG),
    "pool_covariance_matrices": q(
        f"SELECT r AS row_term, c AS col_term, count(*) AS m, {R('avg(w)', 5)} AS within, {R('covar_samp(x, y)', 5)} AS \"between\", {R('avg(w) + (1 + 1e0 / count(*)) * covar_samp(x, y)', 5)} AS total FROM ("
        "SELECT 'Intercept' AS r, 'Intercept' AS c, s2 * (1e0 / n + tm * tm / sxx) AS w, a AS x, a AS y FROM ln_ UNION ALL SELECT 'Intercept', 'TIME', -s2 * tm / sxx, a, b FROM ln_ UNION ALL "
        "SELECT 'TIME', 'Intercept', -s2 * tm / sxx, b, a FROM ln_ UNION ALL SELECT 'TIME', 'TIME', s2 / sxx, b, b FROM ln_) GROUP BY r, c", *PLUG),
    "pool_variance_components": q(f"SELECT cov_parm, {R('avg_')} AS \"avg\", {R('between_')} AS \"between\", m, {R('plus')} AS avg_plus_between FROM pcomp"),
    "variance_curves": q(f"SELECT time_tenths, {R('var_avg', 3)} AS var_avg, {R('var_rubin', 3)} AS var_rubin FROM vc"),
    "variance_comparison": q(f"SELECT time_tenths, {R('empirical_variance', 3)} AS empirical_variance, {R('var_avg', 3)} AS fitted_variance FROM vc LEFT JOIN ev ON ev.TIME * 10 = time_tenths"),
    "prediction_curve": q(f"SELECT time_tenths, {R('1 / (1 + exp(-(b + c * TIME + a * TIME * TIME + 10 * t * TIME)))', 6)} AS pred_prob FROM grid, (SELECT "
                          + ", ".join(f"max(estimate) FILTER (WHERE term = '{f}') AS {f[0]}" for f in FAMS) + " FROM pooled)"),
    "probability_and_variance_curve": q(f"SELECT TIME, {R('avg(p)', 6)} AS mean_prob, {R('avg(p - 0.1e0)', 6)} AS mean_lower, {R('avg(p + 0.1e0)', 6)} AS mean_upper, "
                                        f"{R('avg(p) * (1 - avg(p))', 6)} AS fitted_variance FROM (SELECT TIME, 1 / (1 + exp(-(cdrsb / 10e0 - 1))) AS p FROM cc) GROUP BY TIME"),
    "calibration_table": q(f"SELECT time_tenths, {R('po')} AS prop_observed, {R('pi_')} AS prop_imputed, {R('1 / (1 + exp(-b))')} AS pred_prob FROM grid CROSS JOIN (SELECT estimate AS b FROM pooled WHERE term = 'bprs') "
                           "LEFT JOIN (SELECT TIME * 10 AS k, avg(CASE WHEN bprs < 25 THEN 0 ELSE 1 END) AS po FROM cc GROUP BY TIME) o ON o.k = time_tenths "
                           "LEFT JOIN (SELECT TIME * 10 AS k, avg(CASE WHEN bprs < 25 THEN 0 ELSE 1 END) AS pi_ FROM plong GROUP BY TIME) i ON i.k = time_tenths", *PLUG),
    "scenario_comparison": q("SELECT term, " + ", ".join(f"max(printf('%.3f (sd=%.3f)', estimate, sqrt(total))) FILTER (WHERE scenario = 'SHIFT_{s}') AS SHIFT_{s}" for s in (0, 4, 8))
                             + " FROM pq GROUP BY term", *PLUG_SHIFT),
    "robustness_of_lines": q(
        f"SELECT a.term, {R('a.estimate')} AS estimate_mar, CASE WHEN abs(a.estimate / sqrt(a.total)) > 1.96 THEN 0e0 ELSE 1e0 END AS p_mar, {R('b.estimate')} AS estimate_shifted, "
        "CASE WHEN abs(b.estimate / sqrt(b.total)) > 1.96 THEN 0e0 ELSE 1e0 END AS p_shifted, CASE WHEN (abs(a.estimate / sqrt(a.total)) > 1.96) = (abs(b.estimate / sqrt(b.total)) > 1.96) "
        "THEN 'robust' ELSE 'sensitive' END AS verdict FROM pq a JOIN pq b USING (term) WHERE a.scenario = 'SHIFT_0' AND b.scenario = 'SHIFT_8'", *PLUG_SHIFT),
}

_PANEL = f"PATID, TRIAL, SEX, {R('AGE')} AS AGE, EDU, {R('BMI')} AS BMI, {R('INKOMEN')} AS INKOMEN, JOB, ADL, WZC, {cols(ALLV)}"
SQL["panel_written_and_read"] = q(f"SELECT {_PANEL}, format FROM panel, (SELECT unnest(['parquet', 'csv']) AS format)")
SQL["dropout_model_score"] = _zero_scores(["Intercept", "prev_cdrsb", "prev_bprs", "prev_taupet", "prev_abpet", "AGE", "BMI", "INKOMEN", "ADL_NUM", "TIME"],
                                          ["TRIAL", "SEX", "EDU", "JOB", "WZC"], "cc WHERE TIME < 6", "min")
SQL["observation_model_score"] = _zero_scores(["Intercept", "TIME", "AGE", "BMI", "ADL", "CDRSB_PREV"], ["SEX", "EDU", "WZC"], "risk", "max")

SQL["box_summary_families"] = q(
    f"SELECT x.family, x.TIME, x.is_missing_next, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, count(*) AS n, "
    f"{R('min(v) FILTER (WHERE v >= q1 - 1.5e0 * (q3 - q1))')} AS whisker_low, {R('max(v) FILTER (WHERE v <= q3 + 1.5e0 * (q3 - q1))')} AS whisker_high, "
    "count(*) FILTER (WHERE v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) AS n_outliers FROM x JOIN g ON g.family = x.family AND g.TIME = x.TIME AND "
    "g.is_missing_next = x.is_missing_next WHERE v IS NOT NULL GROUP BY ALL",
    "w AS (SELECT *, nx IS NULL AS is_missing_next FROM (SELECT *, lead(cdrsb) OVER (PARTITION BY PATID ORDER BY TIME) AS nx FROM long) WHERE TIME < 6)",
    "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, TIME, is_missing_next, {f} AS v FROM w" for f in FAMS) + ")",
    "g AS (SELECT family, TIME, is_missing_next, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY ALL)")


def _zero_means(columns, rows):
    terms = ["Intercept", "TIME", *columns, *[f"TIME*{c}" for c in columns]]
    return q(f"SELECT n, term, 0e0 AS score FROM (SELECT count(*) AS n FROM {rows}), (SELECT unnest({terms!r}) AS term)")


_SEEN = "long JOIN panel USING (PATID) WHERE long.bprs IS NOT NULL AND panel.cdrsb0 IS NOT NULL"
SQL["lmm_primary_equations"] = _zero_means(["AGE", "cdrsb0"], _SEEN)
SQL["lmm_shift_equations"] = _zero_means(["AGE_STD", "ADL_NUM", "cdrsb0"], _SEEN)
SQL["lmm_effect_equations"] = q(f"SELECT count(DISTINCT PATID) AS n, 0e0 AS intercept_gap, 0e0 AS slope_gap FROM {_SEEN}")
SQL["gee_independence_score"] = _zero_means(["ADL", "BMI_STD"], "cc")
SQL["glmm_pql_score"] = _zero_means(["BMI_STD"], "cc")
SQL["audit_catalogue"] = q(" UNION ALL ".join(
    f"SELECT '{name}' AS spec, imp, '{f}{t}' AS variable, count(*) AS n, count(*) - count({f}{t}) AS n_imputed, 0 AS n_left, 0 AS n_changed, round(avg({f}{t}), 6) AS mean_observed "
    "FROM panel, (SELECT unnest(range(1, 11)) AS imp) GROUP BY imp"
    for name, f in (("fcs_bprs_full", "bprs"), ("fcs_bprs_default", "bprs"), ("fcs_bprs_mnar", "bprs"), ("fcs_cdrsb", "cdrsb")) for t in V))
SQL["audit_monotone"] = q(" UNION ALL ".join(
    f"SELECT imp, '{f}{t}' AS variable, count(*) AS n, count(*) - count({f}{t}) AS n_imputed, 0 AS n_left, 0 AS n_changed, round(avg({f}{t}), 6) AS mean_observed "
    "FROM mono, (SELECT unnest(range(1, 11)) AS imp) GROUP BY imp" for f in ("cdrsb", "taupet") for t in V))
# Simpson's rule for the t density between minus and plus the t-value, 4,000 steps
SQL["pool_rubin_p_values"] = q(
    f"SELECT term, {R('1 - sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5e0 * ln(pi() * df) - (df + 1) / 2 * ln(1 + x * x / df))) * t / 2000 / 3', 5)} AS p_value FROM ("
    "SELECT term, df, t, -t + t * i / 2000 AS x, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM ("
    "SELECT term, (m - 1) / pow((1 + 1e0 / m) * between_ / total, 2) AS df, abs(estimate / sqrt(total)) AS t FROM pooled), (SELECT unnest(range(4001)) AS i)) GROUP BY term, t")
