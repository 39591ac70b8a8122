"""Code books of the clinical tables.  Fixed values: codes and labels of the study."""

GENDER = {1: "male", 2: "female", 3: "diverse", 4: "no gender", 5: "not specified"}

DIAGNOSIS = {
    1: "Depressive Disorder",
    2: "Specific Phobia",
    3: "Social Anxiety Disorder",
    4: "Agoraphobia and/or Panic Disorder",
    5: "Generalized Anxiety Disorder",
    6: "Obsessive-Compulsive Disorder",
    7: "Post-Traumatic Stress Disorder",
}

MARITAL_STATUS = {1: "single", 2: "married/registered partnership", 3: "divorced", 4: "separated", 5: "widowed", 6: "other"}

EMPLOYABILITY = {0: "employable", 1: "unemployable (on sick leave)", 2: "on disability pension", 3: "on retirement pension", 4: "other"}

EMPLOYABILITY_SIMPLE = {0: "yes", 1: "no", 2: "no", 3: "no", 4: "no"}

GRADUATION = {
    0: "still in school",
    1: "no school degree",
    2: "elementary school degree or equivalent",
    3: "middle school degree or equivalent",
    4: "high school diploma/university entrance qualification",
    5: "other",
}

PROFESSION = {
    0: "still in training or studies",
    1: "no training degree",
    2: "vocational training, including technical school",
    3: "university or college degree",
    4: "other",
}

PRIOR_TREATMENT = {
    0: "no prior treatment",
    1: "outpatient psychotherapy",
    2: "inpatient or partial inpatient treatment/psychotherapy",
    3: "both",
    4: "yes",
}

PRIOR_TREATMENT_SIMPLE = {0: "no prior treatment", 1: "prior psychotherapy", 2: "prior inpatient", 3: "prior inpatient", 4: "prior psychotherapy"}

YES_NO = {0: "no", 1: "yes"}

SMARTPHONE = {0: "Android", 1: "iPhone"}

SPECIAL_EVENT = {0: "usual", 1: "special event"}

#: Items of the ten symptom scales (numbers of the 53 questions).
BSI_SCALES = {
    "bsi_somatization": (2, 7, 23, 29, 30, 33, 37),
    "bsi_compulsivity": (5, 15, 26, 27, 32, 36),
    "bsi_insecurity": (20, 21, 22, 42),
    "bsi_depression": (9, 16, 17, 18, 35, 50),
    "bsi_anxiety": (1, 12, 19, 38, 45, 49),
    "bsi_aggression": (6, 13, 40, 41, 46),
    "bsi_phobia": (8, 28, 31, 43, 47),
    "bsi_paranoia": (4, 10, 24, 48, 51),
    "bsi_psychotizism": (3, 14, 34, 44, 53),
    "bsi_additional": (11, 25, 39, 52),
}

ACTIVITY_CODES = (102, 103, 104, 105, 106, 107)
SHORT_VERSIONS = ("Kurz", "Kurz (Wechsel/Abbruch)")
LONG_VERSIONS = ("Lang", "Lang(Wechsel)")
FINISHED = "Abgeschlossen"
