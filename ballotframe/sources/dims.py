"""Dimension tables: parties, regions, pollsters, views, cards.

All of them are literal and below 500 rows. They are inline tables, so their
size is known to the optimizer, which broadcasts them without a hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .inline import inline_table

# Party codes and labels, in display order.
PARTIES = [
    ("labour", "Labour"), ("conservative", "Conservative"), ("libdems", "Lib Dems"), ("snp", "SNP"),
    ("ukip", "Reform"), ("plaidcymru", "Plaid Cymru"), ("green", "Green"), ("uu", "UUP"),
    ("sinnfein", "Sinn Féin"), ("sdlp", "SDLP"), ("dup", "DUP"), ("alliance", "Alliance"),
    ("other", "Other"), ("others", "Others"),
]

# Party labels of the referendum maps where they differ or are added.
REFERENDUM_LABELS = {"ukip": "UKIP", "leave": "Leave", "remain": "Remain"}

# Parties of the poll model, in model order.
MODEL_PARTIES = [
    "conservative", "labour", "libdems", "green", "snp", "ukip", "plaidcymru",
    "other", "sdlp", "sinnfein", "alliance", "dup", "uu",
]

# National parties, shown as one bucket in the extended seat list.
NATIONAL_PARTIES = ["snp", "plaidcymru", "uu", "dup", "alliance", "sdlp", "sinnfein"]

# Display bucket of each party in the extended seat list, in column order.
BUCKETS = ["con", "lab", "lib", "ukip", "green", "nat", "oth"]
BUCKET_OF = {
    "conservative": "con", "labour": "lab", "libdems": "lib", "ukip": "ukip", "green": "green",
    "other": "oth", **{party: "nat" for party in NATIONAL_PARTIES},
}

# Parties a user may set in each nation.
NATION_PARTIES = {
    "scotland": ["conservative", "labour", "libdems", "ukip", "green", "snp", "other", "others"],
    "wales": ["conservative", "labour", "libdems", "ukip", "green", "plaidcymru", "other", "others"],
    "northernireland": ["dup", "sinnfein", "uu", "sdlp", "alliance", "other", "others"],
    "default": ["conservative", "labour", "libdems", "ukip", "green", "other", "others"],
}

# Region codes and labels.
ENGLAND = [
    "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland",
    "southwestengland", "eastofengland", "eastmidlands", "westmidlands", "london",
]
REGION_LABELS = {
    "london": "London", "southeastengland": "S.E. England", "southwestengland": "S. W. England",
    "westmidlands": "W. Midlands", "northwestengland": "N. W. England",
    "northeastengland": "N. E. England", "yorkshireandthehumber": "Yorks & Humber",
    "eastmidlands": "E. Midlands", "eastofengland": "E. England", "scotland": "Scotland",
    "wales": "Wales", "northernireland": "N. Ireland", "unitedkingdom": "United Kingdom",
    "greatbritain": "Great Britain", "england": "England",
}
REGION_GROUPS = {
    "england": ENGLAND,
    "greatbritain": [*ENGLAND, "scotland", "wales"],
    "unitedkingdom": [*ENGLAND, "scotland", "wales", "northernireland"],
}
REGIONS = REGION_GROUPS["unitedkingdom"]

# Millions of residents per region.
POPULATIONS = {
    "northeastengland": 2.597, "northwestengland": 7.052, "yorkshireandthehumber": 5.284,
    "eastmidlands": 6.034, "westmidlands": 5.602, "eastofengland": 5.847, "london": 8.665,
    "southeastengland": 8.635, "southwestengland": 5.289, "wales": 3.063, "scotland": 5.373,
    "northernireland": 1.869,
}

# Seats per region and party before the 600-seat map.
SEATS_BASELINE = {
    "northeastengland": {"labour": 26, "conservative": 3},
    "northwestengland": {"labour": 54, "conservative": 20, "libdems": 1},
    "yorkshireandthehumber": {"labour": 37, "conservative": 17, "libdems": 0},
    "southeastengland": {"conservative": 72, "labour": 8, "green": 1, "libdems": 2, "others": 1},
    "southwestengland": {"conservative": 47, "labour": 7, "libdems": 1},
    "eastofengland": {"conservative": 50, "labour": 7, "libdems": 1, "ukip": 0},
    "eastmidlands": {"conservative": 31, "labour": 15},
    "westmidlands": {"conservative": 35, "labour": 24},
    "london": {"labour": 49, "conservative": 21, "libdems": 3},
    "scotland": {"snp": 35, "conservative": 13, "labour": 7, "libdems": 4},
    "wales": {"labour": 28, "conservative": 8, "libdems": 0, "plaidcymru": 4},
    "northernireland": {"uu": 0, "dup": 10, "sdlp": 0, "sinnfein": 7, "others": 1},
}

# Base weight of each pollster.
POLLSTER_WEIGHTS = {
    "me": 10000, "ashcroft": 1, "icm": 1.25, "icm2": 1.25, "icm3": 1.25, "icmmissing": 1.25,
    "mori": 1.25, "survation": 1.25, "survationall": 1.25, "survationscotland": 6, "yougov": 1.3,
    "yougov2": 1.3, "yougov3": 1.5, "yougovall": 2, "comres": 1, "comresdm": 1, "opinium": 1,
    "opinium2": 1, "opiniummissing": 1, "bmg": 0.75, "gfk": 1, "panelbasescotland": 3,
    "yougovwales": 6, "yougovscotland": 6, "yougovregional": 6, "lucidtalk": 1, "panelbase": 1,
    "yougovlondon": 6, "orb": 1, "redfield": 1, "whitestone": 1, "deltapoll": 1,
}
FIXED_WEIGHTS = {"me": 10_000_000.0, "lucidtalk": 10_000_000.0}
PERCENT_POLLSTERS = ["yougov", "yougov2"]
UNSCALED_POLLSTERS = ["yougov3", "yougovall", "deltapoll", "lucidtalk"]
UNSCALED_IF_COMPAT = ["opinium2", "mori"]

# Poll codes and pollsters left out of the model, the tracker or the last-pollster mark.
MODEL_EXCLUDED_CODES = [1001]
LATEST_EXCLUDED_CODES = [1000, 1001]
TRACKER_EXCLUDED_COMPANIES = [
    "me", "yougovscotland", "survationscotland", "panelbasescotland", "yougovwales", "lucidtalk", "yougovlondon",
]

# Pollsters shown under their own name, and the name they are shown under.
DISPLAY_COMPANY = {
    "yougov": "yougov", "icm": "icm", "mori": "mori", "opinium": "opinium", "comres": "comres",
    "icm2": "icm", "comresdm": "comres", "icmmissing": "icm", "opiniummissing": "opinium",
}

# Parties with their own line in the tracker.
TRACKER_PARTIES = ["labour", "conservative", "libdems", "snp", "ukip", "green"]

# Poll areas that repeat voters of another area of the same poll.
REPEATED_AREAS = [("mori", "England"), ("icm", "Wales"), ("icm", "Scotland")]

# How overlapping poll areas are corrected (company, source, target, factor).
# Each corrected area is a signed sum of the areas as published.
OVERLAP_RULES = [
    ("icm", "North", "North", 1), ("icm", "Scotland", "Scotland", 1), ("icm", "Scotland", "North", -1),
    ("icm", "Midlands", "Midlands", 1), ("icm", "Wales", "Wales", 1), ("icm", "Wales", "Midlands", -1),
    ("mori", "Wales", "Wales", 0), ("mori", "South", "Wales", 1), ("mori", "Midlands", "Wales", 1),
    ("mori", "North", "Wales", 1), ("mori", "London", "Wales", 1), ("mori", "England", "Wales", -1),
    ("mori", "Midlands", "Midlands", 0), ("mori", "England", "Midlands", 1),
    ("mori", "South", "Midlands", -1), ("mori", "North", "Midlands", -1), ("mori", "London", "Midlands", -1),
    ("mori", "South", "South", 1), ("mori", "North", "North", 1), ("mori", "London", "London", 1),
]

# Seats adjusted by hand before modelling: one party is raised by a
# factor, or seeded with a share of another party, which is then dropped.
ADJUSTED_SEATS = [
    "Beaconsfield", "South West Hertfordshire", "East Devon", "Devon East", "Exmouth and Exeter East",
    "Hertfordshire South West",
]
ADJUSTMENT = ("libdems", 1.4, "others", 0.5, "others")

# Views (name, map, current election, previous election, and the
# flags election / predict / battlegrounds / redistribute / show_turnout).
VIEWS = [
    ("current", "650map_new", "current", "e2019", False, False, False, False, False),
    ("election2024", "650map_new", "e2024", "e2019_new", True, False, True, False, True),
    ("election2019", "650map", "e2019", "e2017", True, False, True, False, True),
    ("election2019_new", "650map_new", "e2019_new", "e2019_new", True, False, True, False, False),
    ("election2017", "650map", "e2017", "e2015", True, False, True, False, True),
    ("election2015", "650map", "e2015", "e2010", True, False, False, False, True),
    ("election2010", "650map", "e2010", "e2010", False, False, False, False, True),
    ("prediction", "650map", "predict", "e2019", True, False, True, False, False),
    ("prediction_new", "650map_new", "predict_new", "e2019_new", True, False, True, False, False),
    ("predictit", "650map_new", "e2024", "e2024", True, True, True, False, False),
    ("predictit_new", "650map_new", "e2019_new", "e2019_new", True, True, True, False, False),
]
DEFAULT_VIEW = "election2024"
OWN_BASE_VIEW = "election2017"  # battlegrounds of this view use the current election

# Card classes, types, rarities, sets and play modes.
CARD_LABELS = {
    "class": {
        "NEUTRAL": "Neutral", "WARRIOR": "Warrior", "ROGUE": "Rogue", "MAGE": "Mage", "PALADIN": "Paladin",
        "PRIEST": "Priest", "DRUID": "Druid", "WARLOCK": "Warlock", "SHAMAN": "Shaman", "HUNTER": "Hunter",
    },
    "type": {"MINION": "Minion", "SPELL": "Spell", "WEAPON": "Weapon"},
    "rarity": {"LEGENDARY": "Legendary", "EPIC": "Epic", "RARE": "Rare", "COMMON": "Common", "FREE": "Free"},
    "set": {
        "BRM": "Blackrock", "EXPERT1": "Expert", "OG": "Old Gods", "TGT": "Grand Tourney",
        "GANGS": "Gadgetzan", "KARA": "Karazhan", "CORE": "Core", "LOE": "Explorers",
        "GVG": "Goblins/Gnomes", "NAXX": "Naxxramas", "REWARD": "Reward", "UNGORO": "Ungoro",
        "HOF": "Hall of Fame",
    },
}
CARD_RACES = ["", "BEAST", "ELEMENTAL", "MECHANICAL", "PIRATE", "DEMON", "DRAGON", "MURLOC", "TOTEM"]
COST_BUCKETS = ["0", "1", "2", "3", "4", "5", "6", "7plus"]
STANDARD_SETS = ["EXPERT1", "OG", "GANGS", "KARA", "CORE", "UNGORO"]

# The areas each pollster reports, with the regions each covers.
POLLSTER_AREAS = {
    "me": {
        "Northern Ireland": ["northernireland"],
        "England": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland",
            "eastofengland", "eastmidlands", "westmidlands", "london",
        ],
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East England": ["southeastengland"],
        "South West England": ["southwestengland"],
        "North East England": ["northeastengland"],
        "North West England": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East of England": ["eastofengland"],
    },
    "general": {
        "All": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland", "eastofengland",
            "eastmidlands", "westmidlands", "london", "scotland", "wales",
        ],
    },
    "icmmissing": {
        "All": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland", "eastofengland",
            "eastmidlands", "westmidlands", "london", "scotland", "wales",
        ],
    },
    "opiniummissing": {
        "All": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland", "eastofengland",
            "eastmidlands", "westmidlands", "london", "scotland", "wales",
        ],
    },
    "icm": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands", "eastofengland"],
        "South": ["southeastengland", "southwestengland", "london"],
    },
    "icm2": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands", "eastofengland"],
        "South": ["southeastengland", "southwestengland", "london"],
    },
    "comresdm": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands", "eastofengland"],
        "South": ["southeastengland", "southwestengland", "london"],
    },
    "icm3": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "South East": ["southeastengland", "london", "eastofengland"],
        "South West": ["southwestengland"],
        "Midlands": ["eastmidlands", "westmidlands"],
        "North England": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
    },
    "mori": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands", "eastofengland"],
        "South": ["southeastengland", "southwestengland"],
        "London": ["london"],
    },
    "opinium2": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands"],
        "South": ["southeastengland", "southwestengland", "eastofengland"],
        "London": ["london"],
    },
    "yougov2": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands"],
        "South": ["southeastengland", "southwestengland", "eastofengland"],
        "London": ["london"],
    },
    "survation": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Midlands": ["eastmidlands", "westmidlands"],
        "South": ["southeastengland", "southwestengland", "eastofengland"],
        "London": ["london"],
        "England": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland",
            "eastofengland", "eastmidlands", "westmidlands", "london",
        ],
    },
    "yougov": {
        "London": ["london"],
        "Rest of South": ["southeastengland", "southwestengland", "eastofengland"],
        "Midlands and Wales": ["eastmidlands", "westmidlands", "wales"],
        "North England": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
        "Scotland": ["scotland"],
    },
    "deltapoll": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "London": ["london"],
        "Rest of South": ["southeastengland", "southwestengland", "eastofengland"],
        "Midlands": ["eastmidlands", "westmidlands"],
        "North": ["northeastengland", "northwestengland", "yorkshireandthehumber"],
    },
    "opinium": {
        "England": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland",
            "eastofengland", "eastmidlands", "westmidlands", "london",
        ],
        "Scotland": ["scotland"],
        "Wales": ["wales"],
    },
    "yougov3": {
        "England": [
            "northeastengland", "northwestengland", "yorkshireandthehumber", "southeastengland", "southwestengland",
            "eastofengland", "eastmidlands", "westmidlands", "london",
        ],
        "Scotland": ["scotland"],
        "Wales": ["wales"],
    },
    "yougovall": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire": ["yorkshireandthehumber"],
        "East": ["eastofengland"],
    },
    "yougovregional": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire": ["yorkshireandthehumber"],
        "East": ["eastofengland"],
    },
    "panelbase": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire": ["yorkshireandthehumber"],
        "East Anglia": ["eastofengland"],
    },
    "gfk": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East of England": ["eastofengland"],
    },
    "survationall": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East": ["eastofengland"],
    },
    "orb": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorks and Humber": ["yorkshireandthehumber"],
        "Eastern": ["eastofengland"],
    },
    "redfield": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorks and Humber": ["yorkshireandthehumber"],
        "Eastern": ["eastofengland"],
    },
    "whitestone": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East": ["southeastengland"],
        "South West": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorks and Humber": ["yorkshireandthehumber"],
        "Eastern": ["eastofengland"],
    },
    "bmg": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East England": ["southeastengland"],
        "South West England": ["southwestengland"],
        "North East England": ["northeastengland"],
        "North West England": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East of England": ["eastofengland"],
    },
    "comres": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East England": ["southeastengland"],
        "South West England": ["southwestengland"],
        "North East England": ["northeastengland"],
        "North West England": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East of England": ["eastofengland"],
        "Eastern": ["eastofengland"],
    },
    "ashcroft": {
        "Scotland": ["scotland"],
        "Wales": ["wales"],
        "East Midlands": ["eastmidlands"],
        "West Midlands": ["westmidlands"],
        "London": ["london"],
        "South East England": ["southeastengland"],
        "South West England": ["southwestengland"],
        "North East": ["northeastengland"],
        "North West": ["northwestengland"],
        "Yorkshire and Humber": ["yorkshireandthehumber"],
        "East of England": ["eastofengland"],
    },
    "survationscotland": {
        "Scotland": ["scotland"],
    },
    "panelbasescotland": {
        "Scotland": ["scotland"],
    },
    "yougovscotland": {
        "Scotland": ["scotland"],
    },
    "yougovwales": {
        "Wales": ["wales"],
    },
    "yougovlondon": {
        "London": ["london"],
    },
    "lucidtalk": {
        "Northern Ireland": ["northernireland"],
    },
}


def party(spark: SparkSession) -> DataFrame:
    rows = [(code, label, ord_, BUCKET_OF.get(code)) for ord_, (code, label) in enumerate(PARTIES)]
    return inline_table(spark, {"party": "string", "label": "string", "ord": "int", "bucket": "string"}, rows)


def referendum_party(spark: SparkSession) -> DataFrame:
    labels = {**dict(PARTIES), **REFERENDUM_LABELS}
    return inline_table(spark, {"party": "string", "label": "string"}, labels.items())


def nation_party(spark: SparkSession) -> DataFrame:
    rows = [(nation, p, i) for nation, parties in NATION_PARTIES.items() for i, p in enumerate(parties)]
    return inline_table(spark, {"nation": "string", "party": "string", "ord": "int"}, rows)


def region(spark: SparkSession) -> DataFrame:
    rows = [(code, label, POPULATIONS.get(code)) for code, label in REGION_LABELS.items()]
    return inline_table(spark, {"region": "string", "label": "string", "population_m": "double"}, rows)


def region_group(spark: SparkSession) -> DataFrame:
    rows = [(group, r) for group, regions in REGION_GROUPS.items() for r in regions]
    return inline_table(spark, {"region_group": "string", "region": "string"}, rows)


def seats_baseline(spark: SparkSession) -> DataFrame:
    rows = [(r, p, n) for r, parties in SEATS_BASELINE.items() for p, n in parties.items()]
    return inline_table(spark, {"region": "string", "party": "string", "seats": "bigint"}, rows)


def pollster(spark: SparkSession, compat: bool = False) -> DataFrame:
    """Weights and scale of each pollster; ``compat`` leaves two more pollsters unscaled."""
    unscaled = UNSCALED_POLLSTERS + (UNSCALED_IF_COMPAT if compat else [])

    def kind(company: str) -> str:
        if company in PERCENT_POLLSTERS:
            return "percent"
        return "none" if company in unscaled else "count"

    rows = [(c, float(w), kind(c), FIXED_WEIGHTS.get(c)) for c, w in POLLSTER_WEIGHTS.items()]
    columns = {"company": "string", "base_weight": "double", "scale_kind": "string", "fixed_weight": "double"}
    return inline_table(spark, columns, rows)


def pollster_area(spark: SparkSession) -> DataFrame:
    rows = [
        (company, area, r)
        for company, areas in POLLSTER_AREAS.items()
        for area, regions in areas.items()
        for r in regions
    ]
    return inline_table(spark, {"company": "string", "area": "string", "region": "string"}, rows)


def overlap_rules(spark: SparkSession) -> DataFrame:
    columns = {"company": "string", "area": "string", "target_area": "string", "factor": "bigint"}
    return inline_table(spark, columns, OVERLAP_RULES)


def seat_adjustments(spark: SparkSession) -> DataFrame:
    columns = {
        "seat": "string", "party": "string", "factor": "double", "seed_from": "string",
        "seed_share": "double", "drop_party": "string",
    }
    return inline_table(spark, columns, [(seat, *ADJUSTMENT) for seat in ADJUSTED_SEATS])


def display_company(spark: SparkSession) -> DataFrame:
    return inline_table(spark, {"company": "string", "shown": "string"}, DISPLAY_COMPANY.items())


def view_def(spark: SparkSession) -> DataFrame:
    columns = {
        "view_id": "string", "map": "string", "current_id": "string", "previous_id": "string",
        "election": "boolean", "predict": "boolean", "battlegrounds": "boolean",
        "redistribute": "boolean", "show_turnout": "boolean",
    }
    return inline_table(spark, columns, VIEWS)


def card_label(spark: SparkSession) -> DataFrame:
    rows = [(facet, code, label) for facet, labels in CARD_LABELS.items() for code, label in labels.items()]
    return inline_table(spark, {"facet": "string", "code": "string", "label": "string"}, rows)
