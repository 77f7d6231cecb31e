"""Registered queries: each operator on the star-schema views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.fixed_values import EUROPEAN_WEIGHTS, MI_CODES, STROKE_CODES, STROKE_SUBTYPES
from ..operators import cohort as co
from ..operators import codelists as cl
from ..operators import compare, denominators, matrices, prefixes, quantiles, rates, spells, trends
from ..operators import events as ev
from ..sources import files, lines, snapshots, tables, versions
from . import derived, pipelines, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# ---- bands and plain counts


def _ages(spark, sf):
    age = bands.age_years(F.col("event_date"), F.col("dob"))
    daily = rates.person_day_counts(star.events(spark, sf))
    return daily.join(star.cohort(spark, sf), "pid").withColumn("age", age)


def _band_totals(ages, band):
    return ages.groupBy(band.alias("age_gp")).agg(F.sum("n").alias("n_events"))


@query
def age_band_open(spark, sf):
    return _band_totals(_ages(spark, sf), bands.age_band_open(F.col("age")))


@query
def age_band_closed(spark, sf):
    return _band_totals(_ages(spark, sf), bands.age_band_closed(F.col("age")))


@query
def monthly_counts(spark, sf):
    return rates.monthly_counts(star.events(spark, sf))


@query
def distinct_person_days(spark, sf):
    return star.events(spark, sf).select("pid", "event_date").distinct()


# ---- cohort


def _areas(spark, sf):
    return co.area_lookup(star.small_areas(spark, sf), star.AREA_CODES)


def _cohort(spark, sf, **options):
    person = star.persons_without_area(spark, sf)
    return co.build_cohort(person, _areas(spark, sf), star.INDEX_DATE, **options)


def _follow(spark, sf):
    people = _cohort(
        spark, sf, max_age=None, deprivation_col="imd5", band_rule="open", flag_col="in_gp"
    )
    first = star.events(spark, sf).select("pid", F.col("event_date").alias("record_date"))
    return co.follow_up(people, first, star.STUDY_END)


@query
def area_lookup(spark, sf):
    return _areas(spark, sf)


@query
def distinct_areas(spark, sf):
    return _areas(spark, sf).agg(F.countDistinct("lsoa").alias("n_areas"))


@query
def cohort(spark, sf):
    return _cohort(spark, sf).select(
        "pid", "dob", "sex", "ethnicity", "lsoa", "area", "imd5", "imd10", "age_gp"
    )


@query
def cohort_gp(spark, sf):
    people = _cohort(
        spark, sf, max_age=None, deprivation_col="imd5", band_rule="open", flag_col="in_gp"
    )
    return people.select("pid", "sex", "ethnicity", "lsoa", "area", "imd5", "age_gp")


@query
def follow_up(spark, sf):
    return _follow(spark, sf).select("pid", "start_date", "end_date")


@query
def person_months(spark, sf):
    return co.person_months(_follow(spark, sf))


# ---- several spells per person


@query
def spell_union(spark, sf):
    return spells.union_spells(star.spells(spark, sf), study_end=star.STUDY_END)


@query
def events_in_spells(spark, sf):
    records = star.records(spark, sf).select("pid", "event_id", "line", "event_date")
    return spells.events_in_spells(records, star.spells(spark, sf), study_end=star.STUDY_END)


@query
def spell_person_months(spark, sf):
    persons = star.persons_without_area(spark, sf)
    return spells.spell_person_months(star.spells(spark, sf), persons, study_end=star.STUDY_END)


# ---- code lists


def _codelist(spark, sf):
    return cl.codelist(star.parts_as_codes(spark, sf), star.MEASURE_BRANDS, star.MEASURE_EXCLUDED)


@query
def codelist_clusters(spark, sf):
    return _codelist(spark, sf)


@query
def codelist_merge(spark, sf):
    parts = star.table(spark, sf, "part")
    a = parts.select(F.col("p_brand").alias("code"), F.col("p_name").alias("term"))
    b = parts.select(F.col("p_type").alias("Code"), F.col("p_name").alias("Description"))
    return cl.merge_codelists(a, b)


@query
def codes_excluded(spark, sf):
    parts = star.table(spark, sf, "part").select(
        F.col("p_name").alias("code"),
        F.col("p_brand").alias("cluster"),
        F.col("p_type").alias("description"),
    )
    return cl.codes_excluded(parts, "Brand#7", "Brand#8", ("SMALL", "PROMO"))


@query
def cluster_sizes(spark, sf):
    return cl.cluster_sizes(star.parts_as_codes(spark, sf))


@query
def event_subtype(spark, sf):
    subtype = cl.subtype_of(F.col("code4"), STROKE_SUBTYPES)
    events = star.admissions(spark, sf).withColumn("subtype", subtype)
    return events.where(F.col("subtype").isNotNull()).groupBy("subtype", "code4").agg(
        F.count(F.lit(1)).alias("n_events")
    )


@query
def tsv_codelist(spark, sf):
    codes = files.read_tsv(spark, derived.code_tsv(spark, sf), "code string, subtype string")
    return cl.subtype_codes(codes)


@query
def prefix_match(spark, sf):
    return prefixes.match_prefixes(star.long_codes(spark, sf), cl.subtype_codes(star.short_codes(spark, sf)))


# ---- events


def _incident(spark, sf):
    return pipelines.incident_events(
        star.events(spark, sf, star.AFTER, star.BEFORE).drop("category", "archived_on"),
        star.cohort(spark, sf),
    )


def _incident_by_priority(spark, sf):
    events = star.events(spark, sf, star.AFTER, star.BEFORE).drop("archived_on")
    return pipelines.incident_events(
        events, star.cohort(spark, sf), ("pid", "category")
    ).withColumnRenamed("category", "measure")


@query
def diagnosis_match(spark, sf):
    return ev.match_codes(
        star.admissions(spark, sf, star.AFTER, star.BEFORE).drop("code4"),
        "code_concat",
        STROKE_CODES,
    )


@query
def outcome_match(spark, sf):
    matched = ev.match_outcomes(
        star.admissions(spark, sf).drop("code4"),
        "code_concat",
        {"stroke": STROKE_CODES, "mi": MI_CODES},
    )
    return ev.first_event(matched, ("pid", "outcome"), ("event_date", "event_id", "code"))


@query
def incident_event(spark, sf):
    return _incident(spark, sf).select("pid", "event_id", "event_date", "event_mo", "area", "dob")


def _medication(spark, sf):
    """First order line per person and drug category, with the person's area."""
    lines = star.records(spark, sf, star.drug_categories(spark, sf), first_of="category").drop("value")
    first = ev.first_per_category(lines, "1996-01-01", ("event_date", "event_id", "line"))
    return first.join(star.cohort(spark, sf).select("pid", "area"), "pid")


@query
def incident_by_category(spark, sf):
    return _medication(spark, sf).select(
        "pid", "category", "area", "event_id", "line", "event_date", "event_mo"
    )


@query
def category_counts(spark, sf):
    return rates.monthly_counts(_medication(spark, sf), ("category", "area", "event_mo"))


@query
def registry_events(spark, sf):
    return ev.registry_events(
        star.records(spark, sf), star.cohort(spark, sf), "1996-01-31", "2001-06-01"
    ).select("pid", "event_date", "event_mo", "area")


@query
def registry_by_month(spark, sf):
    return ev.registry_events(
        star.records(spark, sf),
        star.cohort(spark, sf),
        "1996-01-31",
        "2001-06-01",
        dedupe="month",
    ).select("pid", "event_date", "event_mo", "area")


@query
def registry_counts(spark, sf):
    return ev.registry_counts(
        star.records(spark, sf), star.cohort(spark, sf), "1996-01-31", None, dedupe=None
    )


def _coded(spark, sf):
    codes = _codelist(spark, sf).where(F.col("rf") == "BP").select("code")
    listed = star.records(spark, sf, codes).select("pid", "event_date", "code")
    return ev.first_per_month(listed, star.cohort(spark, sf), "1996-01-01")


@query
def coded_events(spark, sf):
    return _coded(spark, sf)


@query
def coded_monthly(spark, sf):
    return rates.monthly_counts(_coded(spark, sf))


@query
def reconcile_monthly(spark, sf):
    admitted = rates.monthly_counts(_incident(spark, sf))
    registered = ev.registry_counts(star.records(spark, sf), star.cohort(spark, sf), star.AFTER)
    return compare.reconcile(admitted, registered, "admission", "registry")


def _agreement(spark, sf):
    records = star.records(spark, sf)
    sources = {
        "admission": star.events(spark, sf, star.AFTER, star.BEFORE).where("category = '1-URGENT'"),
        "registry": records.where("line = 1"),
        "gp": records.where("line = 2"),
    }
    return compare.person_agreement(sources)


@query
def person_agreement(spark, sf):
    return _agreement(spark, sf)


@query
def agreement_by_month(spark, sf):
    return compare.agreement_by_month(_agreement(spark, sf), "admission", "registry")


@query
def latest_per_year(spark, sf):
    events = star.events(spark, sf).select("pid", "event_date", "event_id")
    return ev.latest_per_year(events).select(
        "pid", "event_year", "event_id", "event_date"
    )


def _deaths(spark, sf, causes=None):
    deaths = star.deaths(spark, sf)
    if causes is not None:
        # The causes are few, so they are looked up before the join on the person.
        deaths = ev.cause_specific(deaths, causes)
    people = star.cohort(spark, sf).select("pid", "area", "dob")
    return ev.registered_deaths(deaths, people, "19960101")


def _cause_specific(spark, sf):
    return _deaths(spark, sf, ev.chapter_codes(star.cause_codes(spark, sf), "S"))


@query
def deaths_monthly(spark, sf):
    return rates.monthly_counts(_deaths(spark, sf))


@query
def deaths_yearly(spark, sf):
    return rates.monthly_counts(_cause_specific(spark, sf), ("event_year",))


@query
def cause_specific_deaths(spark, sf):
    return _cause_specific(spark, sf).select(
        "pid", "area", "cause", "description", "event_date", "event_mo"
    )


# ---- measures


def _measures(spark, sf, band_at="index"):
    labelled = star.records(spark, sf, _codelist(spark, sf).select("code", "rf"))
    return ev.followed_measures(labelled, _follow(spark, sf), band_at=band_at)


@query
def measure_records(spark, sf):
    return _measures(spark, sf)


@query
def measure_records_event_band(spark, sf):
    return _measures(spark, sf, "event").select("pid", "rf", "event_date", "age_gp")


@query
def measure_records_spells(spark, sf):
    """Measures inside any of a person's spells, which overlap and nest."""
    age = bands.age_years(F.col("start_date"), F.col("dob"))
    held = star.spells(spark, sf).join(star.persons_without_area(spark, sf), "pid")
    follow = held.withColumn("age_gp", bands.age_band_open(age)).where("end_date IS NOT NULL")
    labelled = star.records(spark, sf, _codelist(spark, sf).select("code", "rf"))
    return ev.followed_measures(labelled, follow, spells=True)


@query
def measure_counts(spark, sf):
    return ev.measure_counts(_measures(spark, sf))


@query
def measure_trend(spark, sf):
    return ev.measure_trend(_measures(spark, sf))


@query
def measure_order(spark, sf):
    return ev.measure_order(ev.measure_trend(_measures(spark, sf)))


# ---- denominators and files


@query
def population_projection(spark, sf):
    history = star.population_history(spark, sf)
    return rounded(denominators.population_projection(history, star.PROJECTED_YEAR), "population")


def _population(spark, sf):
    return pipelines.projected_population(star.population_history(spark, sf), star.PROJECTED_YEAR)


@query
def monthly_population(spark, sf):
    return _population(spark, sf)


@query
def population_long(spark, sf):
    return files.population_long(spark, derived.yearly_files(spark, sf))


@query
def population_rejected(spark, sf):
    found = files.population_checked(spark, derived.yearly_files(spark, sf)).rejected
    age = F.regexp_extract("line", "^([^,]*),", 1)
    return found.select(files.year_in_path(F.col("file")).alias("year"), age.alias("age"), "reason")


def _summary(spark, sf):
    long = files.population_long(spark, derived.yearly_files(spark, sf))
    codes = {area: f"A{n:02d}" for n, area in enumerate(derived.area_names(spark, sf))}
    return denominators.population_summary(long, codes)


@query
def population_summary(spark, sf):
    return _summary(spark, sf)


@query
def csv_sink(spark, sf):
    path = tables.scratch_folder(spark, "summary")
    note = F.concat(F.lit('a "b", '), "area", F.lit("\nand more"))
    tables.save_csv(_summary(spark, sf).withColumn("note", note), path)
    schema = "year int, age_gp string, area string, area_code string, population double, note string"
    return files.read_csv(spark, path, schema, multi_line=True)


@query
def block_csv(spark, sf):
    return files.population_blocks(spark, derived.block_files(spark, sf)).drop("file")


@query
def ages_by_area(spark, sf):
    blocks = files.population_blocks(spark, derived.block_files(spark, sf))
    return files.ages_by_area(blocks)


def _checked(spark, sf):
    schema = "pid long, balance double, day date, segment string"
    return lines.read_checked(spark, derived.faulty_csv(spark, sf), schema)


def _part():
    return F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")


@query
def checked_rows(spark, sf):
    return _checked(spark, sf).good


@query
def rejected_rows(spark, sf):
    return _checked(spark, sf).rejected.select(_part(), "line_no", "line", "reason")


@query
def checked_totals(spark, sf):
    return _checked(spark, sf).totals.select(_part(), "lines", "header", "blank", "good", "rejected")


@query
def csv_blank_text(spark, sf):
    schema = "pid long, area string, sex string, ethnicity string, note string"
    return files.read_csv(spark, derived.person_csv(spark, sf), schema, multi_line=True)


@query
def multipart_csv(spark, sf):
    parts = files.read_csv(
        spark, derived.area_parts(spark, sf), "lsoa string, area string, area_code string"
    )
    return co.area_lookup(parts, star.AREA_CODES)


@query
def snapshot_counts(spark, sf):
    archive = spark.read.parquet(derived.event_archive(spark, sf))
    return rates.monthly_counts(tables.snapshot(archive, "O"))


AS_OF, LATER = "1999-12-31", "2001-01-01"


@query
def snapshot_as_of(spark, sf):
    return snapshots.snapshot_as_of(spark, derived.dated_archive(spark, sf), AS_OF).select(
        "event_id", "pid", "event_date", "category", F.col("archived_on").cast("string").alias("archived_on")
    )


@query
def snapshot_difference(spark, sf):
    path = derived.dated_archive(spark, sf)
    old, new = (snapshots.snapshot_as_of(spark, path, day) for day in (AS_OF, LATER))
    return snapshots.snapshot_difference(old, new, ("event_id",), ("pid", "event_date", "category"))


@query
def published_counts(spark, sf):
    path = tables.scratch_folder(spark, "published")
    versions.publish_table(rates.monthly_counts(star.events(spark, sf, before=star.INDEX_DATE), ("event_mo", "category")), path)
    versions.publish_table(rates.monthly_counts(star.events(spark, sf), ("event_mo", "category")), path)
    return versions.published_table(spark, path)


@query
def saved_table(spark, sf):
    path = tables.scratch_folder(spark, "counts")
    counts = rates.monthly_counts(star.events(spark, sf), ("event_mo", "category"))
    return tables.save_table(counts, f"area_trends_monthly_counts_{uuid.uuid4().hex}", path)


@query
def materialised_counts(spark, sf):
    stored = tables.materialise(_incident_by_priority(spark, sf), "incident")
    return rates.monthly_counts(stored, ("measure", "event_mo"))


# ---- rates


@query
def band_counts(spark, sf):
    daily = rates.person_day_counts(star.events(spark, sf)).join(star.cohort(spark, sf), "pid")
    return rates.band_counts(daily, star.FIRST_MONTH, star.LAST_MONTH, weight="n")


@query
def band_counts_distinct(spark, sf):
    daily = rates.person_day_counts(star.events(spark, sf)).join(star.cohort(spark, sf), "pid")
    return rates.band_counts(daily, star.FIRST_MONTH, star.LAST_MONTH, distinct=True)


def _rates(spark, sf):
    return pipelines.event_rates(
        _incident(spark, sf), _population(spark, sf), star.FIRST_MONTH, star.LAST_MONTH
    )


@query
def age_standardised_rate(spark, sf):
    return rounded(_rates(spark, sf), "age_standardised_rate")


@query
def age_standardised_rate_all_events(spark, sf):
    result = pipelines.all_event_rates(
        star.events(spark, sf).drop("category", "archived_on"),
        star.cohort(spark, sf),
        _population(spark, sf),
        star.FIRST_MONTH,
        star.LAST_MONTH,
    )
    return rounded(result, "age_standardised_rate")


@query
def age_standardised_rate_complete(spark, sf):
    counts = rates.band_counts(_incident(spark, sf), star.FIRST_MONTH, star.LAST_MONTH)
    result = rates.age_standardise(
        counts,
        _population(spark, sf),
        EUROPEAN_WEIGHTS,
        complete=True,
        require_unit_sum=False,
    )
    return rounded(result, "age_standardised_rate")


@query
def area_deprivation(spark, sf):
    return rates.area_deprivation(star.cohort(spark, sf))


def _labelled(spark, sf):
    return rates.attach_deprivation(
        _rates(spark, sf), rates.area_deprivation(star.cohort(spark, sf))
    )


@query
def rate_with_deprivation(spark, sf):
    return rounded(_labelled(spark, sf), "age_standardised_rate")


@query
def label_order(spark, sf):
    return rates.label_order(_labelled(spark, sf))


# ---- series and trends


def _series(spark, sf):
    return pipelines.rate_series(
        _rates(spark, sf),
        star.cohort(spark, sf),
        from_month=star.SERIES_FROM,
        breaks=star.BREAKS,
    )


@query
def rolling_mean(spark, sf):
    smooth = trends.rolling_mean(_rates(spark, sf), from_month=star.SERIES_FROM)
    return rounded(smooth, "age_standardised_rate", "rolling_avg")


@query
def period_label(spark, sf):
    return rounded(_series(spark, sf), "age_standardised_rate", "rolling_avg")


@query
def month_index(spark, sf):
    indexed = trends.month_index(_series(spark, sf))
    return indexed.select("area_label", "covid_period", "year_mo", "month_index")


@query
def trend_coefficients(spark, sf):
    table = trends.trend_coefficients(_series(spark, sf)).withColumn("log10_p", F.log10("p_value"))
    return rounded(table, "slope", "se", "p_value", "log10_p")


@query
def trend_line(spark, sf):
    line = trends.trend_line(_series(spark, sf))
    return rounded(line, "fitted", "slope_se_band_low", "slope_se_band_high")


@query
def forest_table(spark, sf):
    table = trends.forest_table(trends.trend_coefficients(_series(spark, sf)))
    return rounded(table, "slope", "se", "upper", "lower")


@query
def forest_bound(spark, sf):
    return rounded(trends.forest_bound(trends.trend_coefficients(_series(spark, sf))), "max_bound")


@query
def heatmap_matrix(spark, sf):
    return rounded(
        trends.heatmap_matrix(_series(spark, sf)), "Pre-COVID", "During COVID", "Post-COVID"
    )


@query
def box_stats(spark, sf):
    stats = trends.box_stats(_series(spark, sf))
    return rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def price_quantiles(spark, sf):
    """Groups of which each is too large to be sorted in one piece."""
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    lines = star.table(spark, sf, "lineitem")
    found = quantiles.exact_quantiles(lines, ("l_returnflag",), "l_extendedprice", shares)
    named = [F.col("q")[i].alias(f"q{int(s * 100):02d}") for i, s in enumerate(shares)]
    return rounded(found.select("l_returnflag", "n", *named), "q05", "q25", "q50", "q75", "q95")


def _rates_by_measure(spark, sf):
    return pipelines.event_rates(
        _incident_by_priority(spark, sf),
        _population(spark, sf),
        star.FIRST_MONTH,
        star.LAST_MONTH,
        keys=("measure", "area"),
    )


@query
def trend_by_measure(spark, sf):
    keys = ("measure", "area_label")
    series = pipelines.rate_series(
        _rates_by_measure(spark, sf),
        star.cohort(spark, sf),
        keys,
        star.SERIES_FROM,
        star.BREAKS,
    )
    return rounded(trends.trend_coefficients(series, keys), "slope", "se", "p_value")


@query
def wide_outcomes(spark, sf):
    labelled = rates.attach_deprivation(
        _rates_by_measure(spark, sf), rates.area_deprivation(star.cohort(spark, sf))
    )
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    labelled = labelled.withColumn("measure", cl.literal_map(names, F.col("measure")))
    wide = trends.wide_outcomes(labelled, ("urgent", "high"), ("medium", "low"))
    return rounded(wide, "urgent_rate", "high_rate", "medium_rate", "low_rate")


# ---- matrices


@query
def area_month_matrix(spark, sf):
    counts = rates.monthly_counts(star.events(spark, sf), ("pid", "event_mo"))
    return matrices.area_month_matrix(counts, star.persons(spark, sf).select("pid", "lsoa"))


@query
def area_month_counts(spark, sf):
    # all incident events lie strictly between star.AFTER and star.BEFORE
    return matrices.area_month_counts(_incident(spark, sf), "1995-02-01", "2001-06-01")
