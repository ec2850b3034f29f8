"""Summary statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import stats, updates
from cohortlens.plans import inputs
from cohortlens.plans.q_views import _with_accounts
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import emean, sround, with_students


@register("analytics_summary", with_students(f"""
SELECT count(*) AS total_students,
       coalesce({sround(emean('attendance'), 2)}, 0e0) AS avg_attendance,
       coalesce({sround(emean('average_score'), 2)}, 0e0) AS avg_score
FROM students"""))
def analytics_summary(spark, sf_dir):
    return stats.analytics_summary(inputs.students(spark, sf_dir))


@register("analytics_by_class", with_students(f"""
SELECT faculty_id, count(*) AS total_students,
       coalesce({sround(emean('attendance'), 2)}, 0e0) AS avg_attendance,
       coalesce({sround(emean('average_score'), 2)}, 0e0) AS avg_score
FROM students GROUP BY faculty_id"""))
def analytics_by_class(spark, sf_dir):
    return stats.analytics_summary(inputs.students(spark, sf_dir), by=["faculty_id"])


@register("risk_distribution", with_students(
    "SELECT risk_level, count(*) AS count FROM students GROUP BY risk_level"))
def risk_distribution(spark, sf_dir):
    return stats.risk_distribution(inputs.students(spark, sf_dir), keep_null=True)


@register("risk_distribution_class", with_students("""
SELECT faculty_id, risk_level, count(*) AS count FROM students
WHERE risk_level IS NOT NULL GROUP BY faculty_id, risk_level"""))
def risk_distribution_class(spark, sf_dir):
    return stats.risk_distribution(inputs.students(spark, sf_dir), keep_null=False, by=["faculty_id"])


def _card_sql():
    parts = []
    for lab in S.RISK_LABELS:
        k = lab.split()[0].lower()
        parts.append(f"cast(sum(CASE WHEN risk_level = '{lab}' THEN 1 ELSE 0 END) AS bigint) AS n_{k}")
    shares = []
    for lab in S.RISK_LABELS:
        k = lab.split()[0].lower()
        shares.append(f"coalesce({sround(f'n_{k} * 1e2 / total', 1)}, 0e0) AS pct_{k}")
    return parts, shares


_P, _SH = _card_sql()


@register("risk_cards", with_students(f"""
SELECT *, {', '.join(_SH)} FROM (
  SELECT faculty_id, count(*) AS total, {', '.join(_P)} FROM students GROUP BY faculty_id) c"""))
def risk_cards(spark, sf_dir):
    return stats.risk_cards(inputs.students(spark, sf_dir), by=["faculty_id"])


@register("risk_cards_all", with_students(f"""
SELECT *, {', '.join(_SH)} FROM (SELECT count(*) AS total, {', '.join(_P)} FROM students) c"""))
def risk_cards_all(spark, sf_dir):
    """Admin view: the same cards over every row."""
    return stats.risk_cards(inputs.students(spark, sf_dir))


@register("score_means_by_risk", with_students(
    "SELECT risk_level, "
    + ", ".join(f"{sround(emean(c), 6)} AS mean_{c}" for c in S.MEAN_COLS)
    + """, CASE risk_level WHEN 'High Risk' THEN 0 WHEN 'Medium Risk' THEN 1 WHEN 'Low Risk' THEN 2
              ELSE 3 END AS label_order
FROM students GROUP BY risk_level"""))
def score_means_by_risk(spark, sf_dir):
    return stats.score_means_by_risk(inputs.students(spark, sf_dir))


@register("class_counts", with_students(
    "SELECT faculty_id, count(*) AS count FROM students GROUP BY faculty_id"))
def class_counts(spark, sf_dir):
    return stats.counts_by(inputs.students(spark, sf_dir), "faculty_id")


@register("role_counts", _with_accounts("""
SELECT r.role, coalesce(c.count, 0) AS count
FROM (VALUES ('admin'), ('faculty'), ('student')) r(role)
LEFT JOIN (SELECT role, count(*) AS count FROM accounts GROUP BY role) c USING (role)"""))
def role_counts(spark, sf_dir):
    st = inputs.students(spark, sf_dir)
    return stats.role_counts(updates.accounts_table(spark, st))


def _corr_sql():
    cols = S.CORRELATION_COLS
    aggs, sels = [], []
    for i, x in enumerate(cols):
        for y in cols[i:]:
            aggs.append(f"corr({x}, {y}) AS r__{x}__{y}")
            sels.append(f"SELECT '{x}' AS x, '{y}' AS y, round(r__{x}__{y}, 6) AS r FROM w")
            if x != y:
                sels.append(f"SELECT '{y}' AS x, '{x}' AS y, round(r__{x}__{y}, 6) AS r FROM w")
    return (with_students("") + ",\nw AS (SELECT " + ", ".join(aggs) + " FROM students)\n"
            + "\nUNION ALL\n".join(sels))


@register("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(inputs.students(spark, sf_dir))


@register("score_histogram", with_students("""
SELECT risk_level, cast(least(floor((average_score - 0e0) / 5e0), 19) AS integer) AS bin, count(*) AS count,
       cast(least(floor((average_score - 0e0) / 5e0), 19) AS integer) * 5e0 + 0e0 AS bin_start
FROM students WHERE average_score IS NOT NULL GROUP BY 1, 2, 4"""))
def score_histogram(spark, sf_dir):
    return stats.histogram(inputs.students(spark, sf_dir))


_BOX_SQL = """
SELECT risk_level, n, "min", "max", q1, median, q3, q3 - q1 AS iqr,
       q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence
FROM (SELECT risk_level, count(*) AS n, min(score_variance) AS "min", max(score_variance) AS "max",
             quantile_cont(score_variance, 0.25) AS q1, quantile_cont(score_variance, 0.5) AS median,
             quantile_cont(score_variance, 0.75) AS q3
      FROM students WHERE score_variance IS NOT NULL GROUP BY risk_level) b"""


@register("variance_box", with_students(f"""
SELECT risk_level, n, "min", "max", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence
FROM ({_BOX_SQL}) x"""))
def variance_box(spark, sf_dir):
    b = stats.box_summary(inputs.students(spark, sf_dir))
    return b.withColumns({c: F.round(c, 6) for c in
                          ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]})


@register("variance_outliers", with_students(f"""
SELECT s.student_id, s.risk_level, s.score_variance
FROM students s JOIN ({_BOX_SQL}) b USING (risk_level)
WHERE s.score_variance < b.lower_fence OR s.score_variance > b.upper_fence"""))
def variance_outliers(spark, sf_dir):
    return stats.box_outliers(inputs.students(spark, sf_dir))


@register("drop_density", with_students("""
, st AS (SELECT risk_level, count(*) AS n, stddev_samp(performance_drop) AS sd,
                min(performance_drop) AS lo, max(performance_drop) AS hi
         FROM students WHERE performance_drop IS NOT NULL GROUP BY risk_level),
vc AS (SELECT risk_level, performance_drop AS v, count(*) AS w
       FROM students WHERE performance_drop IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT risk_level, n, sd * pow(cast(n AS double), -0.2) AS h, gi,
                lo + (hi - lo) / 1e2 * gi AS g
         FROM st, range(0, 101) t(gi))
SELECT risk_level, cast(gi AS integer) AS grid_index, round(g, 6) AS x,
       round(sum(w * exp(-0.5 * pow((g - v) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM grid JOIN vc USING (risk_level)
GROUP BY risk_level, gi, g, n, h"""))
def drop_density(spark, sf_dir):
    return stats.density(inputs.students(spark, sf_dir))


@register("trend_line", with_students("""
, base AS (SELECT risk_level, attendance, average_score FROM students
           WHERE attendance IS NOT NULL AND average_score IS NOT NULL),
px AS (SELECT risk_level, attendance AS xv, count(*) AS c, sum(average_score) AS sy
       FROM base GROUP BY 1, 2),
st AS (SELECT risk_level, count(*) AS n, min(attendance) AS lo, max(attendance) AS hi,
              ceil(count(*) * (2e0 / 3e0)) AS k FROM base GROUP BY 1),
g AS (SELECT px.*, st.k, t.gi, st.lo + (st.hi - st.lo) / 5e1 * t.gi AS g
      FROM px JOIN st USING (risk_level), range(0, 51) t(gi)),
d AS (SELECT *, abs(xv - g) AS d FROM g),
cum AS (SELECT *, sum(c) OVER (PARTITION BY risk_level, gi ORDER BY d
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
h AS (SELECT risk_level, gi, min(d) AS h FROM cum WHERE cum >= k GROUP BY 1, 2),
w AS (SELECT d.*, CASE WHEN h.h > 0 THEN (CASE WHEN d.d / h.h < 1 THEN pow(1 - pow(d.d / h.h, 3), 3)
                                             ELSE 0e0 END)
                       WHEN d.d = 0 THEN 1e0 ELSE 0e0 END AS wt
      FROM d JOIN h USING (risk_level, gi)),
a AS (SELECT risk_level, gi, g, sum(wt * c) AS sw, sum(wt * c * xv) AS swx, sum(wt * sy) AS swy,
             sum(wt * c * xv * xv) AS swxx, sum(wt * sy * xv) AS swxy FROM w GROUP BY 1, 2, 3),
m AS (SELECT *, swx / sw AS mx, swy / sw AS my FROM a)
SELECT risk_level, cast(gi AS integer) AS grid_index, round(g, 6) AS x,
       round(CASE WHEN abs(swxx - sw * mx * mx) > 1e-12
                  THEN my + (swxy - sw * mx * my) / (swxx - sw * mx * mx) * (g - mx) ELSE my END, 4) AS y
FROM m"""))
def trend_line(spark, sf_dir):
    return stats.trend(inputs.students(spark, sf_dir))


@register("score_profile", with_students(
    "SELECT student_id, measure, value FROM students UNPIVOT (value FOR measure IN ("
    + ", ".join(S.PROFILE_COLS) + "))"))
def score_profile(spark, sf_dir):
    return stats.profile(inputs.students(spark, sf_dir))
