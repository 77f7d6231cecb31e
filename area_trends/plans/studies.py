"""The studies on their source tables: column names, dates and code lists filled in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_from_text, in_open_range, month_start
from ..functions.fixed_values import (
    LONDON_AREA_CODES,
    MEASURE_CLUSTERS,
    MEASURE_EXCLUDED_TEXT,
    MERSEY_AREA_CODES,
    MI_CODES,
    POPULATION_AGE_BANDS,
    STROKE_CODES,
)
from ..operators import cohort as co
from ..operators import codelists as cl
from ..operators import events as ev
from ..operators.denominators import population_summary
from ..operators.rates import age_standardise, area_deprivation, attach_deprivation, band_counts
from ..sources import files
from ..sources.tables import snapshot
from .pipelines import incident_events, projected_population

# Source column -> name used by the operators.
DEMOGRAPHICS = {
    "person_id": "pid",
    "date_of_birth": "dob",
    "sex": "sex",
    "ethnicity_5_group": "ethnicity",
    "imd_decile": "imd10",
    "imd_quintile": "imd5",
    "date_of_death": "dod",
    "lsoa": "lsoa",
}
DISTRICT_LOOKUP = {"LSOA11CD": "lsoa", "LAD13NM": "area", "LAD13CD": "area_code"}
WARD_LOOKUP = {
    "LSOA21CD": "lsoa",
    "LAD24NM": "area",
    "LAD24CD": "area_code",
    "WD24CD": "ward",
    "WD24NM": "ward_name",
}
ADMISSIONS = {"PERSON_ID_DEID": "pid", "ADMIDATE": "event_date", "DIAG_3_CONCAT": "codes"}
DEATHS = {
    "DEC_CONF_NHS_NUMBER_CLEAN_DEID": "pid",
    "REG_DATE_OF_DEATH": "reg_dod",
    "S_UNDERLYING_COD_ICD10": "cause",
    "S_COD_CODE_1": "cod_1",
}
CAUSES = {"CODE": "code", "ALT_CODE": "cause", "DESCRIPTION": "description"}
PRESCRIPTIONS = {
    "Person_ID_DEID": "pid",
    "ProcessingPeriodDate": "event_date",
    "PaidBNFName": "med_name",
    "PaidBNFCode": "drug_code",
    "PaidQuantity": "med_qty",
}
DRUGS = {"key_group": "category", "BNF_PRESENTATION_CODE": "drug_code"}
GP_ARCHIVE = {
    "NHS_NUMBER_DEID": "pid",
    "DATE": "event_date",
    "CODE": "code",
    "VALUE1_CONDITION": "value",
}
GP_CURRENT = {"NHS_NUMBER_DEID": "pid", "DATE": "event_date", "CODE": "code"}
CLUSTERS = {"Cluster_ID": "cluster", "ConceptId": "code", "ConceptId_Description": "description"}


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The named columns only, under their new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


# ---- cohorts


def adult_cohort(
    demographics: DataFrame,
    lookup: DataFrame,
    area_codes: Mapping[str, str] = LONDON_AREA_CODES,
) -> DataFrame:
    """Adults of the districts on 1 April 2018."""
    areas = co.area_lookup(renamed(lookup, DISTRICT_LOOKUP), list(area_codes.values()))
    return co.build_cohort(renamed(demographics, DEMOGRAPHICS), areas, "2018-04-01")


def gp_cohort(
    demographics: DataFrame,
    wards: DataFrame,
    area_codes: Mapping[str, str] = MERSEY_AREA_CODES,
    flagged: bool = True,
) -> DataFrame:
    """Adults of the districts on 25 March 2025, by default only those with GP records."""
    areas = co.area_lookup(renamed(wards, WARD_LOOKUP), list(area_codes.values()))
    columns = {**DEMOGRAPHICS, "in_gdppr": "in_gp"} if flagged else DEMOGRAPHICS
    return co.build_cohort(
        renamed(demographics, columns),
        areas,
        "2025-03-25",
        max_age=None,
        deprivation_col="imd5",
        band_rule="open",
        flag_col="in_gp" if flagged else None,
    )


# ---- outcomes


def _first_admissions(admissions, cohort, codes, before):
    rows = renamed(admissions, ADMISSIONS).withColumn("event_date", F.col("event_date").cast("date"))
    rows = rows.where(in_open_range(F.col("event_date"), "2017-03-31", before))
    matched = ev.match_codes(rows, "codes", codes)
    matched = matched.withColumn("event_mo", month_start(F.col("event_date")))
    return incident_events(matched, cohort, order=("event_date", "code"))


def strokes(admissions: DataFrame, cohort: DataFrame) -> DataFrame:
    """First stroke admission per person, from April 2017 to March 2024."""
    return _first_admissions(admissions, cohort, STROKE_CODES, "2024-04-01")


def heart_attacks(admissions: DataFrame, cohort: DataFrame) -> DataFrame:
    """First heart attack admission per person, from April 2017 to March 2025."""
    return _first_admissions(admissions, cohort, MI_CODES, "2025-04-01")


def deaths(registered: DataFrame, cohort: DataFrame) -> DataFrame:
    """Deaths of the cohort registered since 2018."""
    return ev.registered_deaths(renamed(registered, DEATHS), cohort, "20180101")


def cardiac_deaths(registered: DataFrame, icd: DataFrame, cohort: DataFrame) -> DataFrame:
    """As `deaths`, with an underlying cause of the circulatory chapter."""
    causes = ev.chapter_codes(renamed(icd, CAUSES), "I")
    found = ev.cause_specific(renamed(registered, DEATHS), causes)
    return ev.registered_deaths(found, cohort, "20180101")


def medications(prescriptions: DataFrame, drugs: DataFrame, cohort: DataFrame) -> DataFrame:
    """First prescription per person and drug category since 2017."""
    rows = renamed(prescriptions, PRESCRIPTIONS)
    rows = rows.withColumn("event_date", F.col("event_date").cast("date"))
    first = ev.incident_by_category(rows, renamed(drugs, DRUGS), "drug_code", "2017-01-01")
    return first.join(cohort, "pid")


# ---- registries, as records (pid, event_date) for `registry_events` and `registry_counts`


def _day(column: str):
    return day_from_text(F.substring(F.col(column).cast("string"), 1, 10), "yyyy-MM-dd")


def _registry(df, pid, date):
    return df.select(F.col(f"`{pid}`").alias("pid"), _day(date).alias("event_date"))


def stroke_registry_counts(archive: DataFrame, cohort: DataFrame, archived_on: str = "2024-12-02") -> DataFrame:
    """Monthly arrivals, one per person and day, from May 2018 to October 2024."""
    rows = _registry(snapshot(archive, archived_on), "Person_ID_DEID", "S1FIRSTARRIVALDATETIME")
    return ev.registry_counts(rows, cohort, "2018-04-30", "2024-11-01")


def mi_registry_counts(archive: DataFrame, cohort: DataFrame, archived_on: str = "2025-04-24") -> DataFrame:
    """Monthly arrivals, one per person and day, from April 2017 to March 2025."""
    rows = _registry(snapshot(archive, archived_on), "1_03_NHS_NUMBER_DEID", "ARRIVAL_AT_HOSPITAL")
    return ev.registry_counts(rows, cohort, "2017-03-31", "2025-04-01")


def current_stroke_registry_counts(registry: DataFrame, cohort: DataFrame) -> DataFrame:
    """Monthly onsets since January 2019, every row."""
    rows = _registry(registry, "Person_ID_DEID", "S1ONSETDATETIME")
    return ev.registry_counts(rows, cohort, "2018-12-31", dedupe=None)


def current_mi_registry_counts(registry: DataFrame, cohort: DataFrame) -> DataFrame:
    """Monthly arrivals, one per person and month, since February 2019.

    The month is compared as text `yyyy-MM` with `2019-01-01`, which leaves
    January 2019 out.
    """
    rows = _registry(registry, "NHS_NUMBER_DEID", "ARRIVAL_AT_HOSPITAL")
    return ev.registry_counts(rows, cohort, "2019-01-31", dedupe="month")


# ---- GP records


def gp_events(records: DataFrame, cohort: DataFrame, *codelists: DataFrame) -> DataFrame:
    """One coded record per person and month since 2019; lists hold (code, description)."""
    codes = cl.merge_codelists(*codelists).select("code")
    return ev.coded_events(renamed(records, GP_CURRENT), cohort, codes, "2019-01-01")


def gp_follow_up(archive: DataFrame, cohort: DataFrame) -> DataFrame:
    """Follow-up from 731 days before the first reporting period to death or 31 March 2025."""
    periods = renamed(archive, {"NHS_NUMBER_DEID": "pid", "REPORTING_PERIOD_END_DATE": "record_date"})
    return co.follow_up(cohort, periods, "2025-03-31")


def risk_factors(
    archive: DataFrame, clusters: DataFrame, follow: DataFrame, produced_on: str = "2025-02-04"
) -> DataFrame:
    """Risk-factor records of one production date inside the follow-up."""
    codes = cl.codelist(renamed(clusters, CLUSTERS), MEASURE_CLUSTERS, MEASURE_EXCLUDED_TEXT)
    latest = snapshot(archive, produced_on, "ProductionDate", prefix=True)
    return ev.measure_records(renamed(latest, GP_ARCHIVE), codes, follow)


# ---- rates


def population_from_exports(
    spark: SparkSession,
    paths: str | Sequence[str],
    area_codes: Mapping[str, str] = LONDON_AREA_CODES,
) -> DataFrame:
    """Population per year, band and area from export files with a block per year."""
    blocks = files.population_blocks(spark, paths)
    band = cl.literal_map(POPULATION_AGE_BANDS, F.col("age"))
    return population_summary(blocks.withColumn("age_gp", band), area_codes)


def population_from_yearly_files(
    spark: SparkSession,
    paths: Sequence[str],
    area_codes: Mapping[str, str] = MERSEY_AREA_CODES,
) -> DataFrame:
    """Population per year, band and area from one file per year."""
    return population_summary(files.population_long(spark, paths), area_codes)


def population(history: DataFrame) -> DataFrame:
    """Monthly denominators from rows (year as yyyy-MM-dd, age_gp, lad, population), with 2024 projected."""
    return projected_population(
        history.select(
            F.col("lad").alias("area"),
            F.year(day_from_text(F.col("year").cast("string"), "yyyy-MM-dd")).alias("year"),
            "age_gp",
            F.col("population").cast("double").alias("population"),
        ),
        2024,
    )


def labelled_rates(
    events: DataFrame, cohort: DataFrame, people: DataFrame, keys: tuple[str, ...] = ("area",)
) -> DataFrame:
    """Standardised rates of events with area, date of birth and month, labelled by deprivation."""
    rate = age_standardise(band_counts(events, keys=keys), people)
    return attach_deprivation(rate, area_deprivation(cohort))
