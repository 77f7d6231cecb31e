"""Results depend on these exact words, codes and numbers."""

# Age bands, youngest first, with the age (years) at which the next one starts.
OPEN_BANDS = (("18-39", 40), ("40-59", 60), ("60-79", 80), ("80+", None))

# Age bands with inclusive lower and upper age; ages between two bands match none.
CLOSED_BANDS = (("18-39", 18, 39), ("40-59", 40, 59), ("60-79", 60, 79), ("80+", 80, None))

BAND_LABELS = ("18-39", "40-59", "60-79", "80+")

# Share of each band in the standard population (one city, 2021 census).
STANDARD_WEIGHTS = {
    "18-39": 0.44789403905971137,
    "40-59": 0.2903854979348325,
    "60-79": 0.21385191984090562,
    "80+": 0.047868543164550505,
}

# European standard shares; they add up to 0.785.
EUROPEAN_WEIGHTS = {"18-39": 0.255, "40-59": 0.275, "60-79": 0.205, "80+": 0.050}

DAYS_PER_YEAR = 365.25

PERIOD_LABELS = ("Pre-COVID", "During COVID", "Post-COVID")
PERIOD_BREAKS = ("2020-03-01", "2022-05-01")

COUNT_FIRST_MONTH = "2018-04-01"
COUNT_LAST_MONTH = "2024-10-01"

# Age labels of the yearly population files.
POPULATION_AGE_BANDS = {
    "Age 18": "18-39",
    "Age 19": "18-39",
    "Aged 20-24": "18-39",
    "Aged 25-29": "18-39",
    "Aged 30-34": "18-39",
    "Aged 35-39": "18-39",
    "Aged 40-44": "40-59",
    "Aged 45-49": "40-59",
    "Aged 50-54": "40-59",
    "Aged 55-59": "40-59",
    "Aged 60-64": "60-79",
    "Aged 65-69": "60-79",
    "Aged 70-74": "60-79",
    "Aged 75-79": "60-79",
    "Aged 80-84": "80+",
    "Aged 85+": "80+",
}

STROKE_CODES = ("I61", "I63", "I64")
MI_CODES = ("I21", "I22")

# Stroke subtype of each ICD-10 code.
STROKE_SUBTYPES = {
    "haemorrhagic": (
        "I60", "I600", "I601", "I602", "I603", "I604", "I605", "I606", "I607", "I608", "I609",
        "I61", "I610", "I611", "I612", "I613", "I614", "I615", "I616", "I618", "I619",
        "I62", "I620", "I621", "I629",
    ),
    "ischaemic": (
        "I63", "I630", "I631", "I632", "I633", "I634", "I635", "I636", "I638", "I639",
    ),
    "unspecified": ("I64",),
}

# GP code cluster -> measure label.
MEASURE_CLUSTERS = {
    "NDABMI_COD": "BMI",
    "NDASMOK_COD": "Smoking",
    "ALC_COD": "Alcohol",
    "NDABP_COD": "BP",
    "FASPLASGLUC_COD": "Fasting glucose",
    "IFCCHBAM_COD": "HbA1c",
    "CHOL_COD": "Total cholesterol",
    "HDLCCHOL_COD": "HDL cholesterol",
    "LDLCCHOL_COD": "LDL cholesterol",
    "TRIGLYC_COD": "Triglycerides",
    "EGFR_COD": "eGFR",
    "LFT_COD": "LFT",
}

# Text that rules a term out of one cluster.
MEASURE_EXCLUDED_TEXT = {"NDABMI_COD": "Child"}

# Measures that count without a recorded value.
VALUE_OPTIONAL = ("Smoking", "Alcohol")

# Places of period labels in a chart: shares of the axes, the first label at the top.
LABEL_X = 0.01
LABEL_TOP = 0.95
LABEL_STEP = 0.08

# District codes: Cheshire and Merseyside, and the 33 London boroughs.
MERSEY_AREA_CODES = {
    "Cheshire East": "E06000049",
    "Cheshire West and Chester": "E06000050",
    "Halton": "E06000006",
    "Knowsley": "E08000011",
    "Liverpool": "E08000012",
    "Sefton": "E08000014",
    "St. Helens": "E08000013",
    "Warrington": "E06000007",
    "Wirral": "E08000015",
}
LONDON_AREA_CODES = {
    "Barking and Dagenham": "E09000002",
    "Barnet": "E09000003",
    "Bexley": "E09000004",
    "Brent": "E09000005",
    "Bromley": "E09000006",
    "Camden": "E09000007",
    "City of London": "E09000001",
    "Croydon": "E09000008",
    "Ealing": "E09000009",
    "Enfield": "E09000010",
    "Greenwich": "E09000011",
    "Hackney": "E09000012",
    "Hammersmith and Fulham": "E09000013",
    "Haringey": "E09000014",
    "Harrow": "E09000015",
    "Havering": "E09000016",
    "Hillingdon": "E09000017",
    "Hounslow": "E09000018",
    "Islington": "E09000019",
    "Kensington and Chelsea": "E09000020",
    "Kingston upon Thames": "E09000021",
    "Lambeth": "E09000022",
    "Lewisham": "E09000023",
    "Merton": "E09000024",
    "Newham": "E09000025",
    "Redbridge": "E09000026",
    "Richmond upon Thames": "E09000027",
    "Southwark": "E09000028",
    "Sutton": "E09000029",
    "Tower Hamlets": "E09000030",
    "Waltham Forest": "E09000031",
    "Wandsworth": "E09000032",
    "Westminster": "E09000033",
}
