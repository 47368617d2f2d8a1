"""Builders for the DuckDB oracle SQL of the multi-step operators.

These write the *reference semantics* as plain SQL (CTE chains), independent
of the DataFrame implementation, so the oracle is a real cross-check.
"""

from __future__ import annotations

ROSTER_NUMERIC = ["age", "Medu", "Fedu", "traveltime", "studytime", "failures", "famrel",
                  "freetime", "goout", "Dalc", "Walc", "health", "absences", "G3", "G2", "G1"]
ROSTER_STRING = ["school", "sex", "address", "famsize", "Pstatus", "Mjob", "Fjob", "reason",
                 "guardian", "schoolsup", "famsup", "paid", "activities", "nursery", "higher",
                 "internet", "romantic"]
FEATURE_NUMERIC = ["parent_education_avg", "parent_education_diff", "parent_education_max",
                   "alcohol_total", "alcohol_ratio", "high_alcohol", "social_time",
                   "study_social_ratio", "academic_support", "family_stability",
                   "motivation_score", "risk_composite", "study_efficiency", "home_advantage"]
FEATURE_STRING = ["age_group", "absence_level"]


def q(c: str) -> str:
    return f'"{c}"'


def clean_ctes(src: str, num: list[str], keep: list[str], prefix: str, fit: str = "") -> tuple[str, str]:
    """CTEs for P10 over ``src``, fitted on its rows ``fit`` (a WHERE clause); returns (cte_text, name_of_final_cte)."""
    nf = ", ".join(
        f"CASE WHEN isinf(CAST({q(c)} AS DOUBLE)) OR isnan(CAST({q(c)} AS DOUBLE)) THEN NULL "
        f"ELSE CAST({q(c)} AS DOUBLE) END AS {q(c)}" for c in num)
    keep_s = "".join(f"{q(c)}, " for c in keep)
    med = ", ".join(f"median({q(c)}) AS {q(c)}" for c in num)
    fill = ", ".join(f"coalesce(s.{q(c)}, m.{q(c)}, 0) AS {q(c)}" for c in num)
    keep_f = "".join(f"s.{q(c)}, " for c in keep)
    qs = ", ".join(f"quantile_cont({q(c)}, 0.01) AS {q(c + '__lo')}, "
                   f"quantile_cont({q(c)}, 0.99) AS {q(c + '__hi')}" for c in num)
    clip = ", ".join(
        f"CASE WHEN b.{q(c + '__hi')} > b.{q(c + '__lo')} THEN "
        f"least(greatest(f.{q(c)}, b.{q(c + '__lo')}), b.{q(c + '__hi')}) ELSE f.{q(c)} END AS {q(c)}"
        for c in num)
    keep_c = "".join(f"f.{q(c)}, " for c in keep)
    ctes = f"""{prefix}_nf AS (SELECT {keep_s}{nf} FROM {src}),
{prefix}_med AS (SELECT {med} FROM {prefix}_nf {fit}),
{prefix}_fill AS (SELECT {keep_f}{fill} FROM {prefix}_nf s CROSS JOIN {prefix}_med m),
{prefix}_q AS (SELECT {qs} FROM {prefix}_fill {fit}),
{prefix} AS (SELECT {keep_c}{clip} FROM {prefix}_fill f CROSS JOIN {prefix}_q b)"""
    return ctes, prefix


def yn(c: str) -> str:
    return f"(CASE WHEN {q(c)} = 'yes' THEN 1 ELSE 0 END)"


def cut_sql(x: str, edges, labels, other="NULL") -> str:
    parts = " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN '{lab}'"
                     for i, lab in enumerate(labels))
    return f"CASE {parts} ELSE {other} END"


def features_select(src: str) -> str:
    """F1-F16 over ``src`` (all source columns kept)."""
    acad = f"({yn('schoolsup')} + {yn('famsup')})"
    motiv = f"({yn('higher')} * 2 + {yn('activities')})"
    pst = "(CASE WHEN Pstatus = 'T' THEN 1 WHEN Pstatus = 'A' THEN 0 ELSE 0 END)"
    risk = (f"(failures * 2 + (5 - health) * 0.5 + absences * 0.1 - {acad} - {motiv})")

    def clip(e, lo, hi):
        return f"least(greatest({e}, {lo}), {hi})"

    return f"""SELECT *,
  (Medu + Fedu) / 2 AS parent_education_avg,
  abs(Medu - Fedu) AS parent_education_diff,
  greatest(Medu, Fedu) AS parent_education_max,
  Dalc + Walc AS alcohol_total,
  {clip('Walc / greatest(Dalc, 1e-8)', 0, 10)} AS alcohol_ratio,
  CAST((Dalc + Walc) > 6 AS INT) AS high_alcohol,
  goout + freetime AS social_time,
  {clip('studytime / greatest(goout, 1e-8)', 0, 10)} AS study_social_ratio,
  {acad} AS academic_support,
  {clip(f'famrel * (2 - {pst})', 0, 10)} AS family_stability,
  {motiv} AS motivation_score,
  {clip(risk, -10, 20)} AS risk_composite,
  {clip('studytime * health / greatest(absences, 1)', 0, 50)} AS study_efficiency,
  ({yn('internet')} + {yn('famsup')} + CAST(famrel > 3 AS INT)) AS home_advantage,
  {cut_sql('age', [14, 16, 18, 22], ['young', 'middle', 'old'], "'nan'")} AS age_group,
  {cut_sql('absences', [-1, 0, 5, 15, 100], ['none', 'low', 'medium', 'high'], "'nan'")} AS absence_level
FROM {src}"""


def advanced_features_ctes(num=None, strings=None, src: str = "roster", keep=("student_id",), fit: str = "") -> tuple[str, str, list[str]]:
    """CTE chain roster -> clean -> features -> clean; returns (ctes, final, numeric cols)."""
    num = list(num or ROSTER_NUMERIC)
    strings = list(strings or ROSTER_STRING)
    c1, n1 = clean_ctes(src, num, [*keep, *strings], "c1", fit)
    feats = f"fe AS ({features_select(n1)})"
    num2 = num + FEATURE_NUMERIC
    c2, n2 = clean_ctes("fe", num2, [*keep, *strings, *FEATURE_STRING], "c2", fit)
    return f"{c1},\n{feats},\n{c2}", n2, num2


def rounded(cols, digits: int = 6, alias_from: str = "") -> str:
    return ", ".join(f"round({alias_from}{q(c)}, {digits}) AS {q(c)}" for c in cols)


def outlier_cte(src: str, num: list[str], name: str, threshold: float = 3, fit: str = "", unless: str = "FALSE") -> str:
    """P13 over ``src``: stats from the unfiltered table, one cross-joined row."""
    stats = ", ".join(f"avg({q(c)}) AS {q(c + '__m')}, stddev_samp({q(c)}) AS {q(c + '__s')}"
                      for c in num)
    conds = " AND ".join(
        f"(NOT (st.{q(c + '__s')} > 1e-8) OR t.{q(c)} IS NULL OR isnan(t.{q(c)}) OR isinf(t.{q(c)}) "
        f"OR abs((t.{q(c)} - st.{q(c + '__m')}) / st.{q(c + '__s')}) < {threshold})" for c in num)
    return (f"{name}_st AS (SELECT {stats} FROM {src} {fit}),\n"
            f"{name} AS (SELECT t.* FROM {src} t CROSS JOIN {name}_st st WHERE ({unless}) OR ({conds}))")


def preprocess_ctes(src: str = "roster", split: bool = False) -> tuple[str, str, list[str]]:
    """E11 as CTEs over ``src``: returns (ctes, final cte, feature columns). With ``split``
    every statistic is fitted on the rows with split 'train', and only those can be outliers (E10)."""
    keep = ["student_id", "split"] if split else ["student_id"]
    fit, unless = ("WHERE split = 'train'", "t.split <> 'train'") if split else ("", "FALSE")
    num = [c for c in ROSTER_NUMERIC if c not in ("G1", "G2")]
    ctes, fin, num2 = advanced_features_ctes(num, src=src, keep=keep, fit=fit)
    strings = ROSTER_STRING + FEATURE_STRING
    parts = [ctes, outlier_cte(fin, num2, "o", fit=fit, unless=unless)]
    for s in strings:
        parts.append(
            f"m_{s} AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT coalesce({q(s)}, 'unknown') AS v FROM o {fit} UNION SELECT 'unknown') t)")
    feats_num = [c for c in num2 if c != "G3"]
    # a value that was not fitted on takes the code of 'unknown'
    code = lambda s: f"coalesce(m_{s}.code, (SELECT code FROM m_{s} WHERE v = 'unknown'))"
    sel = ", ".join([f"o.{q(c)}" for c in feats_num] + [f"CAST({code(s)} AS DOUBLE) AS {q(s)}" for s in strings])
    joins = " ".join(f"LEFT JOIN m_{s} ON coalesce(o.{q(s)}, 'unknown') = m_{s}.v" for s in strings)
    kept = ", ".join(f"o.{c}" for c in keep)
    parts.append(f"enc AS (SELECT {kept}, o.G3 AS label, {sel} FROM o {joins})")
    feats = feats_num + strings
    stats = ", ".join(f"avg({q(c)}) AS {q(c + '__m')}, stddev_samp({q(c)}) AS {q(c + '__s')}, "
                      f"stddev_pop({q(c)}) AS {q(c + '__p')}" for c in feats)
    parts.append(f"enc_st AS (SELECT {stats} FROM enc {fit})")

    def scaled(c):
        e = (f"CASE WHEN st.{q(c + '__s')} > 1e-8 THEN (e.{q(c)} - st.{q(c + '__m')}) / st.{q(c + '__p')} "
             f"ELSE e.{q(c)} END")
        return f"CASE WHEN ({e}) IS NULL OR isnan({e}) OR isinf({e}) THEN 0 ELSE {e} END AS {q(c)}"
    kept = ", ".join(f"e.{c}" for c in keep)
    parts.append(f"prep AS (SELECT {kept}, e.label, {', '.join(scaled(c) for c in feats)} "
                 f"FROM enc e CROSS JOIN enc_st st)")
    return ",\n".join(parts), "prep", feats
