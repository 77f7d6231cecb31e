"""The registered queries as plain SQL over the same tables, to compare results with."""

from __future__ import annotations

import re

from ..functions.dates import months_between_first_days
from ..functions.fixed_values import (
    BAND_LABELS,
    EUROPEAN_WEIGHTS,
    MI_CODES,
    PERIOD_LABELS,
    STANDARD_WEIGHTS,
    STROKE_CODES,
    STROKE_SUBTYPES,
)
from . import star
from .derived import AGE_LABELS, SNAPSHOTS


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _band(age: str) -> str:
    return (
        f"CASE WHEN {age} < 40 THEN '18-39' WHEN {age} < 60 THEN '40-59' "
        f"WHEN {age} < 80 THEN '60-79' ELSE '80+' END"
    )


def _age(day: str, dob: str) -> str:
    return f"(date_diff('day', {dob}, {day}) / 365.25)"


def _rate(weights: dict[str, float], n: str) -> str:
    return " + ".join(
        f"({n.format(band=b)} / NULLIF(p.\"{b}\", 0)) * 100000.0 * CAST({w} AS DOUBLE)"
        for b, w in weights.items()
    )


def _counts(keys: str, source: str) -> str:
    bands = ", ".join(f"count(pid) FILTER (WHERE band = '{b}') AS \"{b}\"" for b in BAND_LABELS)
    return (
        f"SELECT {keys}, event_mo, {bands} FROM (SELECT *, {_band(_age('event_date', 'dob'))} AS band "
        f"FROM {source} WHERE event_mo BETWEEN DATE '{star.FIRST_MONTH}' AND DATE '{star.LAST_MONTH}') "
        f"GROUP BY {keys}, event_mo"
    )


def _series(keys: str, source: str) -> str:
    """Rolling mean, cut and period per key."""
    a, b = star.BREAKS
    pre, during, post = PERIOD_LABELS
    return f"""
SELECT *, CASE WHEN year_mo < DATE '{a}' THEN '{pre}' WHEN year_mo <= DATE '{b}' THEN '{during}'
               ELSE '{post}' END AS covid_period,
       CASE WHEN year_mo < DATE '{a}' THEN 1 WHEN year_mo <= DATE '{b}' THEN 2 ELSE 3 END AS period_order
FROM (SELECT *, avg(age_standardised_rate) OVER (PARTITION BY {keys} ORDER BY year_mo
                ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_avg FROM {source})
WHERE year_mo >= DATE '{star.SERIES_FROM}'"""


def _labelled(source: str) -> str:
    return (
        "SELECT r.*, mean_imd, sd_imd, concat_ws('', r.area, '(Mean IMD Decile:', "
        f"CAST(mean_imd AS VARCHAR), ')') AS area_label FROM {source} r LEFT JOIN deprivation d "
        "ON r.area = d.area"
    )


def _fits(keys: str, source: str) -> str:
    """Least squares per key and period; the t tail through log-gamma terms."""
    return f"""
SELECT *, CASE WHEN r2 = 1 THEN 0 WHEN syy = 0 THEN 1 WHEN r2 * df / (1 - r2) > 25 THEN
    exp(df / 2 * ln(1 - r2) + lgamma(df / 2 + 0.5) - lgamma(df / 2)) * sqrt(r2 / pi()) / (df / 2)
    * list_sum(list_transform(range(0, CAST(20 - 40 / ln(1 - r2) AS INTEGER)), lambda k: pow(1 - r2, k)
        * exp(lgamma(df / 2 + 0.5 + k) - lgamma(df / 2 + 0.5) - lgamma(df / 2 + 1 + k) + lgamma(df / 2 + 1))))
    ELSE 1 - CASE WHEN df % 2 = 1
    THEN 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(1, (df - 1) // 2 + 1),
        lambda k: 0.5 * exp(lgamma(k) + lgamma(0.5) - lgamma(k + 0.5)) * pow(cos(th), 2 * k - 1))), 0))
    ELSE sin(th) * coalesce(list_sum(list_transform(range(0, df // 2),
        lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos(th), 2 * k))), 0)
    END END AS p_value
FROM (SELECT *, sqrt((1 - r2) * syy / sxx / df) AS se,
             atan(sqrt(r2 * df / (1 - r2)) / sqrt(df)) AS th
      FROM (SELECT {keys}, covid_period, count(*) AS n_obs, count(*) - 2 AS df, min(m) AS m0, max(m) AS m1,
                   regr_slope(rolling_avg, m) AS slope, regr_intercept(rolling_avg, m) AS icpt,
                   regr_sxx(rolling_avg, m) AS sxx, regr_syy(rolling_avg, m) AS syy,
                   CASE WHEN regr_syy(rolling_avg, m) = 0 THEN 0 ELSE regr_r2(rolling_avg, m) END AS r2
            FROM (SELECT *, year(year_mo) * 12 + month(year_mo) - 1 AS m FROM {source})
            GROUP BY {keys}, covid_period HAVING count(*) > 2))"""


def _first(source: str, keys: str, order: str) -> str:
    return (
        f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"
    )


def _inside(day: str, after: str, before: str | None = None) -> str:
    text = f"{day} > DATE '{after}'"
    return text if before is None else f"{text} AND {day} < DATE '{before}'"


_CLUSTERS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in star.MEASURE_BRANDS.items())
_EXCLUDED = " AND ".join(
    f"NOT (cluster = '{k}' AND contains(description, '{v}'))" for k, v in star.MEASURE_EXCLUDED.items()
)
_SUBTYPE = " ".join(f"WHEN code4 IN ({_list(c)}) THEN '{s}'" for s, c in STROKE_SUBTYPES.items())
_AGE_LABEL = (
    "CASE WHEN age < 20 THEN 'Age ' || CAST(floor(age) AS INT) WHEN age >= 85 THEN 'Aged 85+' "
    "ELSE 'Aged ' || CAST(floor(age / 5) * 5 AS INT) || '-' || CAST(floor(age / 5) * 5 + 4 AS INT) END"
)
_LABEL_BAND = (
    "CASE WHEN label IN ('Age 18', 'Age 19', 'Aged 20-24', 'Aged 25-29', 'Aged 30-34', 'Aged 35-39') "
    "THEN '18-39' WHEN label IN ('Aged 40-44', 'Aged 45-49', 'Aged 50-54', 'Aged 55-59') THEN '40-59' "
    "WHEN label IN ('Aged 60-64', 'Aged 65-69', 'Aged 70-74', 'Aged 75-79') THEN '60-79' "
    "WHEN label IN ('Aged 80-84', 'Aged 85+') THEN '80+' END"
)

# Named parts; each may use the ones above it.
PARTS = {
    "person": """
SELECT c_custkey AS pid, n_name AS area, n_regionkey AS region,
       DATE '1915-01-01' + CAST((c_custkey * 7919) % 25000 AS INTEGER) AS dob,
       CASE WHEN c_custkey % 41 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END END AS sex,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Other ethnic group'
            WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS ethnicity,
       CASE WHEN c_custkey % 97 <> 0 THEN CAST(c_custkey % 10 + 1 AS INTEGER) END AS imd10,
       CASE WHEN c_custkey % 97 <> 0 THEN CAST((c_custkey % 10 + 2) // 2 AS INTEGER) END AS imd5,
       CASE WHEN c_custkey % 13 = 0
            THEN DATE '1996-01-01' + CAST((c_custkey * 31) % 2500 AS INTEGER) END AS dod,
       CASE WHEN c_custkey % 53 = 0 THEN 'W01' ELSE 'E01' END || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
            || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') AS lsoa,
       'A' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS area_code,
       CASE WHEN c_custkey % 7 <> 0 THEN 1 ELSE 0 END AS in_gp
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "event": """
SELECT o_orderkey AS event_id, o_custkey AS pid, CAST(o_orderdate AS DATE) AS event_date,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS event_mo, o_orderpriority AS category,
       o_orderstatus AS archived_on FROM orders""",
    "windowed": f"SELECT * FROM event WHERE {_inside('event_date', star.AFTER, star.BEFORE)}",
    "admission": """
SELECT event_id, pid, event_date, 'I' || (60 + event_id % 7) AS code_a, 'I' || (20 + pid % 5) AS code_b,
       'I' || (60 + event_id % 7) || (pid % 10) AS code4 FROM event""",
    "record": """
SELECT l_orderkey AS event_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS event_date,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS event_mo,
       l_partkey AS code, CASE WHEN l_quantity <= 45 THEN l_quantity END AS value, o_custkey AS pid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "area_small": f"""
SELECT DISTINCT lsoa, area FROM person WHERE area_code IN ({_list(star.AREA_CODES)})""",
    "adult": f"""
SELECT p.* EXCLUDE (area, ethnicity), a.area, {_age(f"DATE '{star.INDEX_DATE}'", 'dob')} AS age,
       CASE WHEN ethnicity IS NULL OR ethnicity = 'Other ethnic group' THEN 'Other/Unknown'
            ELSE ethnicity END AS ethnicity
FROM person p JOIN area_small a ON p.lsoa = a.lsoa
WHERE {_age(f"DATE '{star.INDEX_DATE}'", 'dob')} >= 18 AND sex IS NOT NULL AND p.lsoa LIKE 'E01%'""",
    "adult_gp": f"""
SELECT pid, dob, sex, ethnicity, lsoa, area, imd5, dod, {_band('age')} AS age_gp
FROM adult WHERE imd5 IS NOT NULL AND in_gp = 1""",
    "followed": f"""
SELECT * FROM (
  SELECT a.*, s.start_date, coalesce(dod, DATE '{star.STUDY_END}') AS end_date
  FROM adult_gp a JOIN (SELECT pid, min(event_date) - 731 AS start_date FROM event GROUP BY pid) s
  ON a.pid = s.pid)
WHERE (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date)
      + CASE WHEN day(end_date) = day(start_date)
               OR (end_date = last_day(end_date) AND start_date = last_day(start_date)) THEN 0
             ELSE (day(end_date) - day(start_date)) / 31.0 END >= 1""",
    "spell": f"""
SELECT pid, start_date, least(coalesce(end_date, DATE '{star.STUDY_END}'), DATE '{star.STUDY_END}') AS end_date FROM (
  SELECT o_custkey AS pid, CAST(o_orderdate AS DATE) - CAST(o_orderkey * 37 % 200 AS INTEGER) AS start_date,
         CASE WHEN o_orderkey % 50 <> 0
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey * 53 % 120 - 5 AS INTEGER) END AS end_date FROM orders)""",
    # every day followed, then runs of days
    "island": """
SELECT pid, min(d) AS start_date, max(d) AS end_date FROM (
  SELECT pid, d, d - CAST(row_number() OVER (PARTITION BY pid ORDER BY d) AS INTEGER) AS g FROM (
    SELECT DISTINCT pid, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS d FROM spell))
GROUP BY pid, g""",
    "snapshot": f"""
SELECT e.* EXCLUDE (archived_on, category), s.day AS archived_on,
       CASE WHEN event_id % 31 = 0 AND s.day >= '{SNAPSHOTS[2]}' THEN 'changed' ELSE category END AS category
FROM event e JOIN (SELECT unnest([{_list(SNAPSHOTS)}]) AS day) s ON e.event_date <= CAST(s.day AS DATE)
WHERE NOT (event_id % 19 = 0 AND s.day = '{SNAPSHOTS[2]}')""",
    "source_day": f"""
SELECT DISTINCT pid, event_mo, event_date, source FROM (
  SELECT pid, event_mo, event_date, 'admission' AS source FROM windowed WHERE category = '1-URGENT'
  UNION ALL SELECT pid, event_mo, event_date, CASE line WHEN 1 THEN 'registry' ELSE 'gp' END FROM record WHERE line IN (1, 2))""",
    "agreement": """
SELECT pid, event_mo, CAST(sum(DISTINCT CASE source WHEN 'admission' THEN 1 WHEN 'registry' THEN 2 ELSE 4 END) AS INTEGER) AS sources,
       bool_or(source = 'admission') AS in_admission, bool_or(source = 'registry') AS in_registry, bool_or(source = 'gp') AS in_gp,
       any_value(ar) AS days_admission_registry, any_value(ag) AS days_admission_gp, any_value(rg) AS days_registry_gp
FROM source_day LEFT JOIN (
  SELECT a.pid, a.event_mo, CAST(min(abs(a.event_date - b.event_date)) FILTER (WHERE a.source = 'admission' AND b.source = 'registry') AS INTEGER) AS ar,
         CAST(min(abs(a.event_date - b.event_date)) FILTER (WHERE a.source = 'admission' AND b.source = 'gp') AS INTEGER) AS ag,
         CAST(min(abs(a.event_date - b.event_date)) FILTER (WHERE a.source = 'registry' AND b.source = 'gp') AS INTEGER) AS rg
  FROM source_day a JOIN source_day b USING (pid, event_mo) GROUP BY a.pid, a.event_mo) USING (pid, event_mo)
GROUP BY pid, event_mo""",
    "faulty": """
SELECT part, pid, row_number() OVER (PARTITION BY part ORDER BY pid) + 1 AS line_no, line, kind FROM (
  SELECT c_custkey % 5 AS part, c_custkey AS pid,
    CASE WHEN c_custkey % 11 = 0 THEN c_custkey || ',1.5'
         WHEN c_custkey % 13 = 0 THEN c_custkey || ',1.5,1996-01-01,"a, ""b"" c",more'
         WHEN c_custkey % 17 = 0 THEN c_custkey || ',abc,1996-13-01,x'
         WHEN c_custkey % 19 = 0 THEN c_custkey || ',1.5,1996-01-01,"open' END AS line,
    CASE WHEN c_custkey % 11 = 0 THEN 'missing fields' WHEN c_custkey % 13 = 0 THEN 'extra fields'
         WHEN c_custkey % 17 = 0 THEN 'wrong type: balance, day' WHEN c_custkey % 19 = 0 THEN 'open quote'
         WHEN c_custkey % 23 = 0 THEN 'blank' ELSE 'good' END AS kind FROM customer)""",
    "code": """
SELECT p_partkey AS code, p_brand AS cluster, p_name AS description FROM part""",
    "measure_code": f"""
SELECT cluster, code, description, CASE cluster {_CLUSTERS} END AS rf
FROM code WHERE cluster IN ({_list(star.MEASURE_BRANDS)}) AND {_EXCLUDED}""",
    "incident": f"""
SELECT e.pid, event_id, event_date, event_mo, p.area, p.dob
FROM ({_first('windowed', 'pid', 'event_date, event_id')}) e JOIN person p ON e.pid = p.pid""",
    "incident_measure": f"""
SELECT e.pid, e.category AS measure, event_id, event_date, event_mo, p.area, p.dob
FROM ({_first('windowed', 'pid, category', 'event_date, event_id')}) e JOIN person p ON e.pid = p.pid""",
    "medication": f"""
SELECT e.pid, e.category, p.area, e.event_id, e.line, e.event_date, e.event_mo FROM (
  SELECT r.*, p_type AS category FROM record r JOIN part ON r.code = p_partkey
  QUALIFY row_number() OVER (PARTITION BY pid, p_type ORDER BY event_date, event_id, line) = 1) e
JOIN person p ON e.pid = p.pid WHERE e.event_mo >= DATE '1996-01-01'""",
    "coded": """
SELECT r.pid, r.event_date, r.code, r.event_mo FROM record r JOIN person p ON r.pid = p.pid
WHERE r.code IN (SELECT code FROM measure_code WHERE rf = 'BP') AND r.event_mo >= DATE '1996-01-01'
QUALIFY row_number() OVER (PARTITION BY r.pid, r.event_mo ORDER BY r.event_date, r.code) = 1""",
    "measured": f"""
SELECT DISTINCT r.pid, c.rf, r.event_date, r.event_mo AS test_mo, f.lsoa, f.age_gp,
       f.sex, f.ethnicity, {_band(_age('r.event_date', 'f.dob'))} AS band_then
FROM record r JOIN measure_code c ON r.code = c.code JOIN followed f ON r.pid = f.pid
WHERE (r.value IS NOT NULL OR c.rf IN ('Smoking', 'Alcohol'))
  AND r.event_date BETWEEN f.start_date AND f.end_date""",
    "death": """
SELECT o_custkey AS pid, area, dob, strftime(o_orderdate, '%Y') AS event_year,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS event_mo, CAST(o_orderdate AS DATE) AS event_date,
       'Brand#' || (o_orderkey % 25 + 1) || '/' || (o_custkey * 7 % 50 + 1) AS cause
FROM orders JOIN person ON o_custkey = pid WHERE strftime(o_orderdate, '%Y%m%d') >= '19960101'""",
    "cardiac_death": """
SELECT d.*, c.description FROM death d JOIN (
  SELECT p_brand || '/' || p_size AS cause, min(p_name) AS description
  FROM part WHERE starts_with(p_type, 'S') GROUP BY 1) c ON d.cause = c.cause""",
    "resident": f"""
SELECT * FROM (
  SELECT area, region, y AS year, {_age('make_date(y, 6, 1)', 'dob')} AS age
  FROM person, (SELECT unnest(range({star.FIRST_YEAR}, {star.LAST_YEAR + 1})) AS y)) WHERE age >= 18""",
    "history": f"""
SELECT area, CAST(year AS INTEGER) AS year, age_gp, CAST(n * 100 + 50 + 10 * i AS DOUBLE) AS population
FROM (SELECT g.area, g.year, b.age_gp, b.i, count(r.age) AS n
      FROM (SELECT DISTINCT area, year FROM resident) g
      CROSS JOIN (VALUES ('18-39', 1), ('40-59', 2), ('60-79', 3), ('80+', 4)) b(age_gp, i)
      LEFT JOIN (SELECT *, {_band('age')} AS band FROM resident) r
        ON r.area = g.area AND r.year = g.year AND r.band = b.age_gp
      GROUP BY ALL)""",
    "projection": f"""
SELECT area, age_gp, {star.PROJECTED_YEAR} AS year,
       regr_intercept(population, year) + regr_slope(population, year) * {star.PROJECTED_YEAR} AS population
FROM history GROUP BY area, age_gp""",
    "denominator": f"""
SELECT area, year, make_date(year, m, 1) AS year_mo, {', '.join(f'"{b}"' for b in BAND_LABELS)} FROM (
  SELECT area, year, {', '.join(f"max(population) FILTER (WHERE age_gp = '{b}') AS " + f'"{b}"' for b in BAND_LABELS)}
  FROM (SELECT area, year, age_gp, population FROM history UNION ALL
        SELECT area, year, age_gp, round(population) FROM projection) GROUP BY area, year),
  (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m)""",
    "rate": f"""
SELECT c.area, c.event_mo AS year_mo, {_rate(STANDARD_WEIGHTS, 'c."{band}"')} AS age_standardised_rate
FROM ({_counts('area', 'incident')}) c JOIN denominator p ON c.area = p.area AND c.event_mo = p.year_mo""",
    "measure_rate": f"""
SELECT c.measure, c.area, c.event_mo AS year_mo,
       {_rate(STANDARD_WEIGHTS, 'c."{band}"')} AS age_standardised_rate
FROM ({_counts('measure, area', 'incident_measure')}) c
JOIN denominator p ON c.area = p.area AND c.event_mo = p.year_mo""",
    # Half up on whole numbers: the mean with two decimals, without binary ties.
    "deprivation": """
SELECT area, ((200 * sum(imd10) + count(imd10)) // (2 * count(imd10))) / 100.0 AS mean_imd,
       round(stddev_pop(imd10), 2) AS sd_imd FROM person GROUP BY area""",
    "labelled": _labelled("rate"),
    "labelled_measure": _labelled("measure_rate"),
    "series": _series("area_label", "labelled"),
    "series_measure": _series("measure, area_label", "labelled_measure"),
    "fit": _fits("area_label", "series"),
    "fit_measure": _fits("measure, area_label", "series_measure"),
    "resident_label": f"""
SELECT area, region, year, {_AGE_LABEL} AS label, 1000 * count(*) AS n FROM resident GROUP BY ALL""",
    "yearly": """
SELECT g.year, g.label, a.n_name AS area, r.n
FROM (SELECT DISTINCT year, label FROM resident_label) g CROSS JOIN nation a
LEFT JOIN resident_label r ON r.year = g.year AND r.label = g.label AND r.area = a.n_name
UNION ALL
SELECT g.year, 'All ages', a.n_name, r.n FROM (SELECT DISTINCT year FROM resident_label) g
CROSS JOIN nation a LEFT JOIN (SELECT year, area, sum(n) AS n FROM resident_label GROUP BY ALL) r
ON r.year = g.year AND r.area = a.n_name""",
    "people_file": f"""
SELECT CAST(year AS INTEGER) AS year, make_date(year, 6, 1) AS mid_year, {_LABEL_BAND} AS age_gp, area,
       CAST(n AS DOUBLE) AS population FROM yearly""",
    "people_summary": """
SELECT year, age_gp, s.area, 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS area_code,
       coalesce(sum(population), 0.0) AS population
FROM people_file s JOIN nation ON s.area = n_name WHERE age_gp IS NOT NULL GROUP BY ALL""",
    "block": f"""
SELECT CAST(g.year AS INTEGER) AS year, g.area, g.age, CAST(r.n AS DOUBLE) AS population
FROM (SELECT DISTINCT year, area, unnest([{_list(AGE_LABELS)}]) AS age FROM resident_label) g
LEFT JOIN resident_label r ON r.year = g.year AND r.area = g.area AND r.label = g.age""",
}


def _with(body: str) -> str:
    """The body preceded by the parts it uses, directly or through other parts."""
    needed: set[str] = set()
    text = [body]
    while text:
        words = set(re.findall(r"\w+", text.pop()))
        for name in (words & PARTS.keys()) - needed:
            needed.add(name)
            text.append(PARTS[name])
    parts = ", ".join(f"{n} AS ({PARTS[n].strip()})" for n in PARTS if n in needed)
    return f"WITH {parts}{body}" if body.lstrip().startswith(",") else f"WITH {parts} {body.strip()}" if parts else body.strip()


def _month_columns(rows: str, key: str, empty: str, first: str, last: str) -> str:
    """One column per month from `first` to `last` of rows ({key}, event_mo, value)."""
    cells = ", ".join(
        f"coalesce(max(value) FILTER (WHERE event_mo = DATE '{m}'), {empty}) AS \"{m}\""
        for m in months_between_first_days(first, last)
    )
    return f"SELECT {key}, {cells} FROM ({rows}) GROUP BY {key}"


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_WIDE = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}

BODIES = {
    "spell_union": "SELECT * FROM island",
    "events_in_spells": """
SELECT r.pid, event_id, line, event_date, start_date, end_date
FROM record r JOIN island i ON r.pid = i.pid AND r.event_date BETWEEN i.start_date AND i.end_date""",
    "spell_person_months": f"""
SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       {_band(_age('d', 'dob'))} AS age_gp, sex, ethnicity, lsoa, count(*) AS count
FROM (SELECT pid, min(d) AS d FROM (
        SELECT pid, end_date, CAST(start_date + to_months(CAST(k AS INTEGER)) AS DATE) AS d
        FROM island, (SELECT unnest(range(0, 200)) AS k))
      WHERE d <= end_date GROUP BY pid, year(d), month(d)) JOIN person USING (pid) GROUP BY ALL""",
    "prefix_match": """
SELECT event_id, e.code, l.code AS listed, subtype FROM (
  SELECT event_id, 'I' || (event_id % 7 + 60) || substring(CAST(event_id * 7 % 1000 AS VARCHAR), 1, event_id % 4) AS code FROM event) e
JOIN (SELECT substring('I' || (p_partkey % 9 + 58) || (p_partkey * 3 % 10) || (p_partkey * 7 % 10), 1, 3 + p_partkey // 9 % 3) AS code,
             min(p_brand) AS subtype FROM part GROUP BY 1) l ON starts_with(e.code, l.code)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY length(l.code) DESC) = 1""",
    "person_agreement": "SELECT * FROM agreement",
    "agreement_by_month": """
SELECT event_mo, count(*) FILTER (in_admission AND in_registry) AS n_both,
       count(*) FILTER (in_admission AND NOT in_registry) AS n_only_admission,
       count(*) FILTER (in_registry AND NOT in_admission) AS n_only_registry,
       count(*) FILTER (days_admission_registry = 0) AS n_same_day, count(*) FILTER (days_admission_registry <= 7) AS n_near
FROM agreement WHERE in_admission OR in_registry GROUP BY event_mo""",
    "checked_rows": """
SELECT pid, (pid % 100) + 0.5::DOUBLE AS balance, CASE WHEN pid % 29 <> 0 THEN DATE '1996-01-01' END AS day,
       'a "' || c_mktsegment || '", b' AS segment FROM faulty JOIN customer ON pid = c_custkey WHERE kind = 'good'""",
    "rejected_rows": "SELECT part, line_no, line, kind AS reason FROM faulty WHERE kind NOT IN ('good', 'blank')",
    "checked_totals": """
SELECT part, count(*) + 1 AS lines, CAST(1 AS BIGINT) AS header, count(*) FILTER (kind = 'blank') AS blank,
       count(*) FILTER (kind = 'good') AS good, count(*) FILTER (kind NOT IN ('good', 'blank')) AS rejected
FROM faulty GROUP BY part""",
    "snapshot_as_of": f"""
SELECT event_id, pid, event_date, category, archived_on FROM snapshot WHERE archived_on = '{SNAPSHOTS[1]}'""",
    "snapshot_difference": f"""
SELECT coalesce(a.event_id, b.event_id) AS event_id,
       CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM snapshot WHERE archived_on = '{SNAPSHOTS[1]}') a
FULL JOIN (SELECT * FROM snapshot WHERE archived_on = '{SNAPSHOTS[2]}') b ON a.event_id = b.event_id
WHERE a.event_id IS NULL OR b.event_id IS NULL OR (a.pid, a.event_date, a.category) IS DISTINCT FROM (b.pid, b.event_date, b.category)""",
    "published_counts": "SELECT event_mo, category, count(*) AS count FROM event GROUP BY 1, 2",
    "price_quantiles": """
SELECT l_returnflag, n, round(q[1], 6) AS q05, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75,
       round(q[5], 6) AS q95
FROM (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q
      FROM lineitem GROUP BY l_returnflag)""",
    "age_band_open": f"""
SELECT {_band(_age('event_date', 'dob'))} AS age_gp, count(*) AS n_events
FROM event JOIN person USING (pid) GROUP BY 1""",
    "age_band_closed": f"""
SELECT CASE WHEN age >= 18 AND age <= 39 THEN '18-39' WHEN age >= 40 AND age <= 59 THEN '40-59'
            WHEN age >= 60 AND age <= 79 THEN '60-79' WHEN age >= 80 THEN '80+' ELSE 'Unknown' END AS age_gp,
       count(*) AS n_events
FROM (SELECT {_age('event_date', 'dob')} AS age FROM event JOIN person USING (pid)) GROUP BY 1""",
    "monthly_counts": "SELECT event_mo, count(*) AS count FROM event GROUP BY 1",
    "distinct_person_days": "SELECT DISTINCT pid, event_date FROM event",
    "area_lookup": "SELECT * FROM area_small",
    "distinct_areas": "SELECT count(DISTINCT lsoa) AS n_areas FROM area_small",
    "cohort": """
SELECT pid, dob, sex, ethnicity, lsoa, area, imd5, imd10,
       CASE WHEN age >= 18 AND age <= 39 THEN '18-39' WHEN age >= 40 AND age <= 59 THEN '40-59'
            WHEN age >= 60 AND age <= 79 THEN '60-79' WHEN age >= 80 THEN '80+' ELSE 'Unknown' END AS age_gp
FROM adult WHERE age <= 112 AND imd10 IS NOT NULL""",
    "cohort_gp": "SELECT pid, sex, ethnicity, lsoa, area, imd5, age_gp FROM adult_gp",
    "follow_up": "SELECT pid, start_date, end_date FROM followed",
    "person_months": f"""
SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       {_band(_age('d', 'dob'))} AS age_gp, sex, ethnicity, lsoa, count(*) AS count
FROM (SELECT *, CAST(start_date + to_months(CAST(k AS INTEGER)) AS DATE) AS d
      FROM followed, (SELECT unnest(range(0, 200)) AS k))
WHERE d <= end_date GROUP BY ALL""",
    "codelist_clusters": "SELECT cluster, code, description, rf FROM measure_code",
    "codelist_merge": """
SELECT code, min(description) AS description FROM (
  SELECT p_brand AS code, p_name AS description FROM part
  UNION ALL SELECT p_type, p_name FROM part) GROUP BY code""",
    "codes_excluded": """
SELECT DISTINCT p_name AS code, p_type AS description FROM part
WHERE p_brand = 'Brand#7' AND NOT contains(p_type, 'SMALL') AND NOT contains(p_type, 'PROMO')
  AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = 'Brand#8' AND o.p_name = part.p_name)""",
    "cluster_sizes": "SELECT cluster, count(*) AS n_codes FROM code GROUP BY 1",
    "event_subtype": f"""
SELECT subtype, code4, count(*) AS n_events
FROM (SELECT *, CASE {_SUBTYPE} END AS subtype FROM admission) WHERE subtype IS NOT NULL GROUP BY ALL""",
    "tsv_codelist": "SELECT CAST(p_partkey AS VARCHAR) AS code, p_type AS subtype FROM part",
    "diagnosis_match": f"""
SELECT event_id, pid, event_date, code_a AS code FROM admission
WHERE code_a IN ({_list(STROKE_CODES)}) AND {_inside('event_date', star.AFTER, star.BEFORE)}""",
    "outcome_match": f"""
SELECT * FROM (
  SELECT event_id, pid, event_date, code_a AS code, 'stroke' AS outcome FROM admission
  WHERE code_a IN ({_list(STROKE_CODES)})
  UNION ALL SELECT event_id, pid, event_date, code_b, 'mi' FROM admission
  WHERE code_b IN ({_list(MI_CODES)}))
QUALIFY row_number() OVER (PARTITION BY pid, outcome ORDER BY event_date, event_id, code) = 1""",
    "incident_event": "SELECT pid, event_id, event_date, event_mo, area, dob FROM incident",
    "incident_by_category": "SELECT * FROM medication",
    "category_counts": """
SELECT category, area, event_mo, count(*) AS count FROM medication GROUP BY ALL""",
    "registry_events": f"""
SELECT DISTINCT pid, event_date, event_mo, area FROM record JOIN person USING (pid)
WHERE {_inside('event_date', '1996-01-31', '2001-06-01')}""",
    "registry_by_month": f"""
SELECT pid, min(event_date) AS event_date, event_mo, area FROM record JOIN person USING (pid)
WHERE {_inside('event_date', '1996-01-31', '2001-06-01')} GROUP BY ALL""",
    "registry_counts": f"""
SELECT event_mo, count(*) AS count FROM record JOIN person USING (pid)
WHERE {_inside('event_date', '1996-01-31')} GROUP BY ALL""",
    "coded_events": "SELECT pid, event_date, code, event_mo FROM coded",
    "coded_monthly": "SELECT event_mo, count(*) AS count FROM coded GROUP BY ALL",
    "reconcile_monthly": f"""
SELECT a.event_mo, a.n AS admission_count, b.n AS registry_count, a.n - b.n AS diff
FROM (SELECT event_mo, count(*) AS n FROM incident GROUP BY 1) a
JOIN (SELECT event_mo, count(*) AS n FROM (
        SELECT DISTINCT pid, event_date, event_mo FROM record JOIN person USING (pid)
        WHERE {_inside('event_date', star.AFTER)}) GROUP BY 1) b ON a.event_mo = b.event_mo""",
    "latest_per_year": """
SELECT pid, CAST(year(event_date) AS INTEGER) AS event_year, event_id, event_date FROM event
QUALIFY row_number() OVER (PARTITION BY pid, year(event_date) ORDER BY event_date DESC, event_id DESC) = 1""",
    "deaths_monthly": "SELECT event_mo, count(*) AS count FROM death GROUP BY 1",
    "deaths_yearly": "SELECT event_year, count(*) AS count FROM cardiac_death GROUP BY 1",
    "cause_specific_deaths": """
SELECT pid, area, cause, description, event_date, event_mo FROM cardiac_death""",
    "measure_records": """
SELECT pid, rf, event_date, test_mo, lsoa, age_gp, sex, ethnicity FROM measured""",
    "measure_records_event_band": "SELECT pid, rf, event_date, band_then AS age_gp FROM measured",
    "measure_records_spells": f"""
SELECT pid, rf, event_date, test_mo, lsoa, min(age_gp) AS age_gp, sex, ethnicity FROM (
  SELECT r.pid, c.rf, r.event_date, r.event_mo AS test_mo, p.lsoa, p.sex, p.ethnicity,
         {_band(_age('s.start_date', 'p.dob'))} AS age_gp
  FROM record r JOIN measure_code c ON r.code = c.code JOIN person p ON r.pid = p.pid JOIN (
    SELECT o_custkey AS pid, CAST(o_orderdate AS DATE) - CAST(o_orderkey * 37 % 200 AS INTEGER) AS start_date,
           CAST(o_orderdate AS DATE) + CAST(o_orderkey * 53 % 120 - 5 AS INTEGER) AS end_date
    FROM orders WHERE o_orderkey % 50 <> 0) s ON s.pid = r.pid AND r.event_date BETWEEN s.start_date AND s.end_date
  WHERE r.value IS NOT NULL OR c.rf IN ('Smoking', 'Alcohol')) GROUP BY ALL""",
    "population_rejected": """
SELECT CAST(year AS INTEGER) AS year, label AS age, 'no number: ' || string_agg(area, ', ' ORDER BY n_nationkey) AS reason
FROM yearly JOIN nation ON area = n_name WHERE n IS NULL GROUP BY ALL""",
    "measure_counts": """
SELECT pid, rf, test_mo, lsoa, count(*) AS count FROM measured GROUP BY ALL""",
    "measure_trend": "SELECT test_mo, rf, count(*) AS total_count FROM measured GROUP BY ALL",
    "measure_order": """
SELECT rf, total_count, CAST(row_number() OVER (ORDER BY total_count DESC, rf) AS INTEGER) AS position
FROM (SELECT rf, count(*) AS total_count FROM measured GROUP BY rf)""",
    "population_projection": f"SELECT area, age_gp, year, {_rounded('population')} FROM projection",
    "monthly_population": "SELECT * FROM denominator",
    "population_long": "SELECT * FROM people_file",
    "population_summary": "SELECT * FROM people_summary",
    "csv_sink": "SELECT *, 'a \"b\", ' || area || chr(10) || 'and more' AS note FROM people_summary",
    "block_csv": "SELECT * FROM block",
    "ages_by_area": "SELECT year, age AS \"Age\", "
    + ", ".join(f"max(population) FILTER (WHERE area = 'NATION_{i}') AS \"NATION_{i}\"" for i in range(25))
    + " FROM block GROUP BY year, age",
    "csv_blank_text": """
SELECT pid, area, coalesce(sex, '') AS sex, coalesce(ethnicity, '') AS ethnicity,
       'said "' || area || '", twice' || CASE WHEN pid % 7 = 0 THEN chr(10) || 'next line' ELSE '' END AS note
FROM person""",
    "multipart_csv": "SELECT * FROM area_small",
    "snapshot_counts": """
SELECT event_mo, count(*) AS count FROM event WHERE archived_on = 'O' GROUP BY 1""",
    "saved_table": "SELECT event_mo, category, count(*) AS count FROM event GROUP BY 1, 2",
    "materialised_counts": """
SELECT measure, event_mo, count(*) AS count FROM incident_measure GROUP BY 1, 2""",
    "band_counts": _counts("area", "(SELECT * FROM event JOIN person USING (pid))"),
    "band_counts_distinct": _counts(
        "area",
        f"(SELECT DISTINCT ON (area, event_mo, pid, band0) * FROM (SELECT *, "
        f"{_band(_age('event_date', 'dob'))} AS band0 FROM event JOIN person USING (pid)))",
    ),
    "age_standardised_rate": f"SELECT area, year_mo, {_rounded('age_standardised_rate')} FROM rate",
    "age_standardised_rate_all_events": f"""
SELECT c.area, c.event_mo AS year_mo,
       round({_rate(STANDARD_WEIGHTS, 'c."{band}"')}, 6) AS age_standardised_rate
FROM ({_counts('area', '(SELECT * FROM event JOIN person USING (pid))')}) c
JOIN denominator p ON c.area = p.area AND c.event_mo = p.year_mo""",
    "age_standardised_rate_complete": f"""
SELECT p.area, p.year_mo,
       round({_rate(EUROPEAN_WEIGHTS, 'coalesce(c."{band}", 0)')}, 6) AS age_standardised_rate
FROM denominator p LEFT JOIN ({_counts('area', 'incident')}) c
  ON c.area = p.area AND c.event_mo = p.year_mo""",
    "area_deprivation": "SELECT area, mean_imd, sd_imd FROM deprivation",
    "rate_with_deprivation": f"""
SELECT area, year_mo, {_rounded('age_standardised_rate')}, mean_imd, sd_imd, area_label FROM labelled""",
    "label_order": """
SELECT area_label, mean_imd, row_number() OVER (ORDER BY mean_imd NULLS FIRST, area_label) AS position
FROM (SELECT DISTINCT area_label, mean_imd FROM labelled)""",
    "rolling_mean": f"""
SELECT area, year_mo, {_rounded('age_standardised_rate', 'rolling_avg')}
FROM ({_series('area', 'rate')})""",
    "period_label": f"""
SELECT area, year_mo, {_rounded('age_standardised_rate', 'rolling_avg')}, mean_imd, sd_imd, area_label,
       covid_period, period_order, DATE '{star.BREAKS[0]}' AS first_break, DATE '{star.BREAKS[1]}' AS second_break,
       0.01 AS label_x, round(0.95 - 0.08 * (period_order - 1), 2) AS label_y FROM series""",
    "month_index": """
SELECT area_label, covid_period, year_mo, CAST(date_diff('month',
       min(year_mo) OVER (PARTITION BY area_label, covid_period), year_mo) AS INTEGER) AS month_index
FROM series""",
    "trend_coefficients": f"""
SELECT area_label, covid_period, {_rounded('slope', 'se', 'p_value')}, n_obs,
       round(CASE WHEN p_value > 0 THEN log10(p_value) END, 6) AS log10_p FROM fit""",
    "trend_line": """
SELECT area_label, covid_period, CAST(k AS INTEGER) AS month_index,
       make_date((m0 + k) // 12, (m0 + k) % 12 + 1, 1) AS year_mo, round(y, 6) AS fitted,
       round(y - 1.96 * se, 6) AS slope_se_band_low, round(y + 1.96 * se, 6) AS slope_se_band_high
FROM (SELECT *, icpt + slope * (m0 + k) AS y FROM (
        SELECT *, unnest(range(0, m1 - m0 + 1)) AS k FROM fit))""",
    "forest_table": f"""
SELECT g.area_label, g.covid_period, {_rounded('slope', 'se')}, round(slope + se, 6) AS upper,
       round(slope - se, 6) AS lower
FROM (SELECT DISTINCT area_label, unnest([{_list(PERIOD_LABELS)}]) AS covid_period FROM fit) g
LEFT JOIN fit f ON f.area_label = g.area_label AND f.covid_period = g.covid_period""",
    "forest_bound": """
SELECT round(greatest(abs(max(slope + se)), abs(min(slope - se))) + 0.02, 6) AS max_bound FROM fit""",
    "heatmap_matrix": "SELECT area_label, "
    + ", ".join(
        f"round(avg(age_standardised_rate) FILTER (WHERE covid_period = '{p}'), 6) AS \"{p}\""
        for p in PERIOD_LABELS
    )
    + " FROM series GROUP BY area_label",
    "box_stats": """
SELECT s.area_label, s.covid_period, round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median,
       round(any_value(q[3]), 6) AS q3,
       round(min(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_low,
       round(max(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT x BETWEEN lo AND hi) AS n_outliers
FROM (SELECT area_label, covid_period, age_standardised_rate AS x FROM series) s
JOIN (SELECT *, q[1] - 1.5 * (q[3] - q[1]) AS lo, q[3] + 1.5 * (q[3] - q[1]) AS hi FROM (
        SELECT area_label, covid_period, quantile_cont(age_standardised_rate, [0.25, 0.5, 0.75]) AS q
        FROM series GROUP BY ALL)) b
  ON s.area_label = b.area_label AND s.covid_period = b.covid_period
GROUP BY s.area_label, s.covid_period""",
    "trend_by_measure": f"""
SELECT measure, area_label, covid_period, {_rounded('slope', 'se', 'p_value')}, n_obs FROM fit_measure""",
    "wide_outcomes": "SELECT area, year_mo, mean_imd, area_label, round(u.r, 6) AS urgent_rate, "
    "round(h.r, 6) AS high_rate, round(o.medium, 6) AS medium_rate, round(o.low, 6) AS low_rate FROM "
    + " ".join(
        f"{join}(SELECT area, year_mo, mean_imd, area_label, age_standardised_rate AS r "
        f"FROM labelled_measure WHERE measure = '{_WIDE[m]}') {alias}{using}"
        for m, join, alias, using in (
            ("urgent", "", "u", ""),
            ("high", "JOIN ", "h", " USING (area, year_mo, mean_imd, area_label)"),
        )
    )
    + f""" LEFT JOIN (SELECT m.area, m.year_mo, m.mean_imd, m.area_label,
        m.age_standardised_rate AS medium, l.age_standardised_rate AS low
      FROM labelled_measure m JOIN labelled_measure l USING (area, year_mo, mean_imd, area_label)
      WHERE m.measure = '{_WIDE["medium"]}' AND l.measure = '{_WIDE["low"]}') o
      USING (area, year_mo, mean_imd, area_label)""",
    "area_month_matrix": _month_columns(
        "SELECT lsoa, event_mo, count(*) / 100.0 AS value FROM event JOIN person USING (pid) GROUP BY ALL",
        "lsoa",
        "0.0",
        "1995-01-01",
        "2001-08-01",
    ),
    "area_month_counts": _month_columns(
        "SELECT area, event_mo, count(*) AS value FROM incident GROUP BY ALL", "area", "NULL", "1995-02-01", "2001-06-01"
    ),
}

ORACLE: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
