"""Names of the survey columns, the analyte groups and the class limits."""

from __future__ import annotations

# Survey codes and the names they are given.
CODE_NAMES = {
    "LBXIGE": "Total_IgE",
    "LBXD1": "Dermatophagoides_farinae",
    "LBXD2": "Dermatophagoides_pteronyssinus",
    "LBXE1": "Cat_epithelium",
    "LBXE5": "Dog_epithelium",
    "LBXI6": "German_cockroach",
    "LBXM1": "Alternaria_alternata",
    "LBXW1": "Ragweed",
    "LBXG5": "Rye_grass",
    "LBXG8": "Bermuda_grass",
    "LBXT7": "Oak",
    "LBXT3": "Birch",
    "LBXF13": "Peanut",
    "LBXF1": "Egg_white",
    "LBXF2": "Milk",
    "LBXF24": "Shrimp",
    "RIAGENDR": "Gender",
    "RIDAGEYR": "Age_years",
    "RIDRETH1": "Race_ethnicity",
    "DMDBORN4": "Country_birth",
    "DMDEDUC2": "Education_level",
    "INDFMPIR": "Poverty_income_ratio",
    "BMXBMI": "BMI",
    "BMXHT": "Height_cm",
    "BMXWT": "Weight_kg",
    "DR1TKCAL": "Calorie_intake",
    "DR1TPROT": "Protein_intake",
    "DR1TFAT": "Fat_intake",
    "DR1TCARB": "Carb_intake",
}

KEY = "SEQN"
TOTAL_CODE = "LBXIGE"
TOTAL_NAMES = ("Total_IgE", TOTAL_CODE)

# The analytes of the panel by group.
ANALYTE_GROUPS = {
    "indoor": (
        "Dermatophagoides_farinae",
        "Dermatophagoides_pteronyssinus",
        "Cat_epithelium",
        "Dog_epithelium",
        "German_cockroach",
        "Alternaria_alternata",
    ),
    "outdoor": ("Ragweed", "Rye_grass", "Bermuda_grass", "Oak", "Birch"),
    "food": ("Peanut", "Egg_white", "Milk", "Shrimp"),
}
ANALYTES = tuple(name for group in ANALYTE_GROUPS.values() for name in group)
ANALYTE_CODES = tuple(c for c, name in CODE_NAMES.items() if name in ANALYTES)

# Name parts that mark an analyte column for the group report.
ANALYTE_STEMS = ("Dermatophagoides", "Cat_", "Dog_", "Ragweed", "Peanut", "Milk", "Egg_", "Shrimp")

# Lower limits of the total classes; the last class is open.
TOTAL_CLASSES = (("Normal", 0.0), ("Borderline", 87.0), ("Elevated", 180.0), ("Very_High", 400.0))

# Upper limits (inclusive) of the age groups and of the severity steps.
AGE_GROUPS = (
    ("preschool", 6.0),
    ("school_age", 12.0),
    ("adolescent", 18.0),
    ("young_adult", 40.0),
    ("middle_age", 60.0),
    ("elderly", 100.0),
)
SEVERITY_STEPS = (("none", 0.0), ("mild", 2.0), ("moderate", 5.0), ("severe", 100.0))

SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
POLLEN_MONTHS = (3, 4, 5, 9)

# Trial measurements that may be attached to survey rows.
TRIAL_FEATURES = (
    "IL4_baseline",
    "IL5_baseline",
    "IL13_baseline",
    "IFN_gamma_baseline",
    "Th2_percent",
    "CD4_percent",
    "GATA3_expression",
    "IL4R_expression",
)

ID_COLUMNS = ("SEQN", "subject_id")
TARGET_COLUMNS = ("ige_class", "elevated_ige", "poly_sensitized", "sensitization_severity")

# Study accession of each study, with the name used as its tag.
STUDY_TAGS = {
    "SDY1513": "emp_123",
    "SDY1514": "observational_food",
    "SDY1515": "peanut_sublingual",
    "SDY1520": "peanut_epicutaneous",
}

SURVEY_FILES = (
    "AL_IGE_D",
    "DEMO_D",
    "DEMO_E",
    "DEMO_L",
    "DBQ_D",
    "DBQ_F",
    "DR1TOT_D",
    "DR1TOT_E",
    "DR1TOT_L",
    "MCQ_D",
    "MCQ_E",
    "MCQ_L",
)
