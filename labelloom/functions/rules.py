"""Fixed values of the evidence rules: word lists, tables and patterns.

Values that results must agree with are stated here as plain text; the plans
that use them are elsewhere.
"""

from __future__ import annotations

# LOINC codes of the reviewed label sections, with key and display name.
SECTIONS = {
    "34066-1": ("boxed_warning", "FDA package insert Boxed warning section"),
    "43685-7": ("warnings_and_cautions", "FDA package insert Warnings and precautions section"),
    "34071-1": ("warnings", "FDA package insert Warnings section"),
    "34084-4": ("adverse_reactions", "FDA package insert Adverse reactions section"),
    "34070-3": ("contraindications", "FDA package insert Contraindications section"),
    "34073-7": ("drug_interactions", "FDA package insert Drug interactions section"),
    "43684-0": ("use_in_specific_populations", "FDA package insert Use in specific populations section"),
}
FALLBACK_KEYS = ("boxed_warning", "warnings", "warnings_and_cautions", "adverse_reactions", "contraindications", "drug_interactions", "use_in_specific_populations")
FALLBACK_CODES = {key: code for code, (key, _) in SECTIONS.items()} | {"warnings": "43685-7"}
SEARCHABLE_TYPES = ("paragraph", "list_item", "table_row")

# Statuses in order of priority.
STATUSES = ("explicit_positive", "interaction_dependent", "related_but_not_explicit", "negated", "historical_or_preexisting", "comparator_only", "not_found", "insufficient_label_data")
CONFIDENCES = ("high", "medium", "low")

# Events with their direct and related terms.
EVENTS = {
    "rhabdomyolysis": (("rhabdomyolysis", "muscle breakdown"), ("myopathy",)),
    "bradycardia": (("bradycardia", "slow heart rate", "reduced heart rate"), ()),
    "hypersensitivity": (("hypersensitivity", "anaphylaxis", "anaphylactic reaction", "allergic reaction"), ()),
    "serotonin syndrome": (("serotonin syndrome",), ("serotonergic syndrome", "serotonin toxicity")),
    "hypotension": (("hypotension", "low blood pressure"), ("hypotensive episode",)),
    "qt prolongation": (("qt prolongation", "prolonged qt", "qt interval prolongation"), ()),
    "torsades de pointes": (("torsades de pointes", "torsade de pointes"), ("qt prolongation", "prolonged qt", "qt interval prolongation")),
}

# Patterns of interactions, of populations, doses and times, and clues of routes.
INTERACTIONS = (
    r"\bconcomitant use\b",
    r"\bconcomitant\s+[a-z0-9-]+\b",
    r"\bcoadministration\b",
    r"\bwhen combined with\b",
    r"\bincreases? the risk\b",
    r"\bwith CYP(?:\d\w*)? inhibitors?\b",
    r"\bwith MAOIs?\b",
    r"\bwith other serotonergic drugs?\b",
    r"\bpatients taking\b[^.]{0,100}\band a drug\b",
    r"\bMAOIs?\b",
    r"\bserotonergic drugs?\b",
    r"\bconcomitantly with\b",
    r"\bwith the combination of\b",
    r"\b(?:the\s+)?risk\s+(?:is\s+)?increased with\b",
)
CORE_INTERACTIONS = (
    r"\bconcomitant use\b",
    r"\bconcomitant\s+[a-z0-9-]+\b",
    r"\bcoadministration\b",
    r"\bwhen combined with\b",
    r"\bwith CYP(?:\d\w*)? inhibitors?\b",
    r"\bwith MAOIs?\b",
    r"\bwith other serotonergic drugs?\b",
    r"\bpatients taking\b[^.]{0,100}\band a drug\b",
    r"\bconcomitantly with\b",
    r"\bwith the combination of\b",
    r"\b(?:the\s+)?risk\s+(?:is\s+)?increased with\b",
)
POPULATIONS = (
    r"\belderly patients?\b",
    r"\bpediatric patients?\b",
    r"\b(?:patients|subjects) with heart failure\b",
    r"\brenal impairment\b",
    r"\bhepatic impairment\b",
    r"\bpregnan(?:cy|t women)\b",
    r"\bhypertensive subjects?\b",
    r"\b(?:patients|subjects) with myocardial infarction\b",
)
DOSES = (r"\bdose-related\b", r"\bat doses? above\b[^.;|]*", r"\bduring dose escalation\b")
TIMES = (r"\bafter abrupt withdrawal\b", r"\bwithin the first \d+ days?\b", r"\bduring (?:[a-z0-9-]+\s+){0,3}initiation\b", r"\bpostmarketing\b")
#: (clue, route, pattern)
ROUTE_CLUES = (
    ("oral", "oral", r"\boral(?:ly)?\b"),
    ("topical", "topical", r"\btopical(?:ly)?\b"),
    ("gel", "topical", r"\bgels?\b"),
    ("cream", "topical", r"\bcreams?\b"),
    ("ophthalmic", "ophthalmic", r"\bophthalmic(?:ally)?\b"),
    ("inhaled", "inhaled", r"\b(?:inhaled|inhalation)\b"),
    ("intravenous", "intravenous", r"\bintravenous(?:ly)?\b"),
    ("intramuscular", "intramuscular", r"\bintramuscular(?:ly)?\b"),
    ("subcutaneous", "subcutaneous", r"\bsubcutaneous(?:ly)?\b"),
    ("transdermal", "transdermal", r"\btransdermal(?:ly)?\b"),
    ("tablet", "oral", r"\btablets?\b"),
    ("capsule", "oral", r"\bcapsules?\b"),
)
ROUTES = tuple(dict.fromkeys(r for _, r, _ in ROUTE_CLUES))
FORMULATIONS = ("gel", "cream", "tablet", "capsule")

# Patterns of the numeric rules.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
FREQUENCY = (
    r"\b(?:approximately|about)?\s*\d+(?:\.\d+)?\s*%"
    r"|\b\d+\s+of\s+\d[\d,]*\s+patients?\b"
    r"|\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:cases?|events?)\s+per\s+\d[\d,]*\s+(?:patient-years?|person-years?|patients?)\b"
    r"|\b\d[\d,]*\s+(?:treated\s+)?(?:patients?|subjects?|participants?)\b"
    r"|(?<![\d.])\d+(?:\.\d+)?\s*/\s*\d[\d,]*(?:\.\d+)?(?![\d.])(?:\s+(?:treated\s+patients?|patients?|subjects?|cases?)\b)?"
    r"|\bfrequency cannot be estimated\b"
    r"|\b(?:common|uncommon|rare|rarely)\b"
)
QUALITATIVE = ("common", "uncommon", "rare", "rarely")
POPULATION_RATIO = r"^\s*\d+(?:\.\d+)?\s*/\s*\d[\d,]*(?:\.\d+)?\s+(?:treated\s+patients?|patients?|subjects?|cases?)\b"
BLOOD_PRESSURE = r"(?:\bmm\s*hg\b|\bbp\b|\bblood[ -]pressure\b|\bsystolic\b|\bdiastolic\b|\bhypotension\b|\bhypertension\b|\bless\s+than\b|\bgreater\s+than\b|[<>])"
DOSE_CONTEXT = (
    r"\b(?:mg|mcg|g)\b(?:\s*/\s*day|\s+daily)?|\b(?:dose|dosage|tablet|capsule)\b|\bfixed[ -]dose\s+combination\b"
    r"|\b[a-z][a-z0-9-]*\s*/\s*[a-z][a-z0-9-]*\b"
)
DOSAGE_FORM = (
    r"(?:(?:chewable|orally\s+disintegrating|extended[- ]release|delayed[- ]release|vaginal)\s+tablet"
    r"|(?:delayed[- ]release|vaginal)\s+capsule"
    r"|(?:oral|topical|ophthalmic|otic|nasal|inhalation|injectable|intravenous)\s+(?:solution|suspension|powder)"
    r"|(?:ophthalmic|vaginal)\s+ointment|(?:nasal|transdermal)\s+(?:spray|patch|system)|(?:inhalation|rectal)\s+(?:aerosol|foam)"
    r"|(?:metered[- ]dose|dry[- ]powder)\s+inhaler|(?:prefilled\s+)?syringe|autoinjector|nebulizer\s+solution"
    r"|tablets?|capsules?|caplets?|granules?|powders?|solutions?|suspensions?|syrups?|elixirs?|drops?|concentrates?|creams?|ointments?|gels?|lotions?"
    r"|foams?|shampoos?|rinses?|pastes?|sprays?|aerosols?|inhalers?|injections?|infusions?|vials?|ampules?|cartridges?|patches?"
    r"|suppositories?|enemas?|rings?|implants?|films?|lozenges?|troches?|medicated\s+swabs?|intrauterine\s+systems?|transdermal\s+systems?)"
)
FREQUENCY_CUE = r"\b(?:occurred|occurs?|reported|observed|experienced|developed|incidence|frequency|rate|cases?)\b"
SAMPLE_CUE = r"\b(?:n\s*=|sample\s+size|study\s+population|total\s+of|randomi[sz]ed|enrolled|received\s+treatment|treated)\b"
LAB_OR_VITAL = (
    r"\b(?:blood[ -]pressure|systolic|diastolic|qtc?|heart\s+rate|pulse|temperature|oxygen\s+saturation|spo2|ejection\s+fraction|glucose|creatinine|potassium"
    r"|sodium|hemoglobin|haemoglobin|hematocrit|alt|ast)\b"
)
COMPOSITION = r"\b(?:sodium\s+chloride|dextrose|lipid\s+emulsion|active\s+ingredient)\b"
ADMINISTERED = r"\b(?:received|administered|treated\s+with|dose(?:d)?|dosage|titrated|infusion)\b[^.;]{0,30}\b\d+(?:\.\d+)?\s*(?:mg|mcg|micrograms?|g|units?|mEq|mmol)\b"
COMPARATOR = r"(?:placebo|active[ -]control|comparator|control)"
PEOPLE = r"(?:patients?|subjects?|participants?)"
# What stands before or after a number and gives it a role, and how far it is looked for.
STRENGTH_BEFORE = rf"\b{DOSAGE_FORM}\b(?:\s*,)?\s*(?:contains?\s+)?$"
STRENGTH_AFTER = rf"^\s*(?:[a-z][a-z0-9-]*\s+){{0,3}}{DOSAGE_FORM}\b"
COMPOSITION_AFTER = r"^\s*(?:of\s+)?(?:active\s+ingredient|sodium\s+chloride|dextrose|lipid\s+emulsion)\b"
SAMPLE_THEN_COUNT = r"^\s*,\s*\d[\d,]*\s+(?:developed|experienced|reported|had)\b"
RECEIVED = r"\breceived\b"
COMPARATOR_BEFORE = rf"\b{COMPARATOR}\b[^%]{{0,24}}$"
COMPARATOR_AFTER = rf"^\s*(?:with\s+)?\b{COMPARATOR}\b"
CASES_PER_CUE = r"\b(?:cases?|events?)\s+per\b"
OF_PATIENTS_CUE = r"\b\d+\s+of\s+\d[\d,]*\s+patients?\b"
OF_PEOPLE_AFTER = rf"^\s+of\s+(?:treated\s+)?{PEOPLE}\b"
WINDOWS = {"composition": 50, "pressure": 80, "vital_before": 70, "vital_after": 25, "ratio_after": 40, "dose": 45, "sample_before": 55, "sample_after": 45, "comparator": 35, "cue_before": 100, "outcome_after": 55, "event": 80}
# Forms of a frequency text, with the groups of value and unit.
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
OF_PATIENTS = r"(\d+)\s+of\s+(\d[\d,]*)\s+patients?"
CASES_PER = r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:cases?|events?)\s+per\s+(\d[\d,]*)\s+(patient-years?|person-years?|patients?)"
COUNT_ONLY = r"^\s*(\d[\d,]*)\s+((?:treated\s+)?(?:patients?|subjects?|participants?))\s*$"
RATIO = r"(\d+(?:\.\d+)?)\s*/\s*(\d[\d,]*(?:\.\d+)?)(?:\s+(treated\s+patients?|patients?|subjects?|cases?))?"
UNKNOWN_FREQUENCY = "frequency cannot be estimated"
# Forms of table cells and headers, and of comparators in text.
CELL_PERCENT = r"^[<>]?\d+(?:\.\d+)?\s*%$"
CELL_NUMBER = r"^[<>]?\d+(?:\.\d+)?$"
CELL_DASHES = ("-", "—", "–")
HEADER_PERCENT = r"\(\s*%\s*\)|\bpercent(?:age)?\b"
COMPARATOR_THEN_VALUE = r"\b(placebo|comparator|control)\b[^.;|]{0,80}?(\d+(?:\.\d+)?\s*%|\d+\s*/\s*\d[\d,]*|-)"
VERSUS_VALUE = r"\bversus\s+(\d+(?:\.\d+)?\s*%)\s+with\s+(placebo|comparator|control)\b"
MORE_OFTEN_WITH = r"\bmore\s+(?:often|frequently)\s+with\s+(placebo|comparator|control)\b"
OUTCOME = r"\b(?:developed|experienced|reported|had)\b"
HEADER_POPULATION = r"\bHF\b|heart failure|hypertens|patients?|subjects?|pregnan|renal|hepatic|myocardial"
TEXT_POPULATION = r"(?:elderly|pediatric|hypertensive) (?:patients|subjects)|(?:patients|subjects) with (?:heart failure|myocardial infarction)|patients with (?:renal|hepatic) impairment"
SHARE_OF_POPULATION = rf"((?:approximately|about)?\s*\d+(?:\.\d+)?\s*%)\s+of\s+({TEXT_POPULATION})"
HEADER_IGNORED = ("acetate", "besylate", "calcium", "citrate", "dihydrate", "fumarate", "hydrochloride", "hydrate", "maleate", "monohydrate", "phosphate", "sodium", "succinate", "sulfate", "tartrate")
#: (pattern, name) of comparator columns, first hit wins
COMPARATOR_NAMES = ((r"\bactive[ -]control\b", "Active control"), (r"\bplacebo\b", "Placebo"), (r"\bcomparator\b", "Comparator"), (r"\bcontrol\b", "Control"))

# Patterns of the assertion rules; {t} is the term, {d} the drug.
NEGATED = (
    r"\bno\s+(?:(?:cases?|events?)\s+of\s+)?{t}\b[^.]*\b(?:were|was)?\s*observed\b",
    r"\b{t}\b[^.;]{0,80}\b(?:was|were|is|are|has\s+been|have\s+been)\s+not\s+(?:observed|reported|seen|identified|detected|found)\b",
    r"\b(?:did|does|do)\s+not\s+(?:cause|result\s+in|produce|precipitate|lead\s+to)\b[^.;]{0,80}\b{t}\b",
    r"\bwithout\s+(?:evidence\s+of\s+)?{t}\b",
)
COMPARATOR_ONLY = r"\b{t}\b[^.]*\bmore\s+(?:often|frequently)\s+with\s+(?:placebo|control|comparator)\b"
CONCOMITANT_SUBJECT = r"^\s*concomitant\s+[a-z0-9-]+\s+may\s+increase"
HISTORICAL = (
    r"\bpatients?\s+(?:with|who\s+have)\b[^.;]{0,100}\b{t}\b",
    r"\bcontraindicated\s+in\s+patients?\s+with\b[^.;]{0,100}\b{t}\b",
    r"\b(?:pre-existing|preexisting|known)\b[^.;]{0,50}\b{t}\b",
    r"\bhistory\s+of\b[^.;]{0,80}\b{t}\b",
    r"\bresting\b[^.;]{0,50}\b{t}\b",
    r"\b{t}\b\s*\([^)]*\b(?:resting\s+systolic\s+blood\s+pressure|bp)\b",
    r"\b{t}\b\s*\([^)]*(?:less\s+than|greater\s+than|[<>])[^)]*(?:mm\s*hg|bp|blood[ -]pressure)[^)]*\)",
    r"\bno\s+controlled\s+clinical\s+data\b[^.;]{0,160}\b{t}\b",
)
HISTORICAL_PARENT = r"\bgroups?\s+of\s+patients?\b|\bpatients?\s+(?:were\s+)?not\s+included\s+in\s+(?:clinical\s+)?trials?\b|\bthe\s+drug\s+is\s+not\s+recommended\s+for\s+the\s+following\s+groups?\b"
HISTORICAL_DRUG = r"\b{d}\b\s+is\s+not\s+recommended\s+for\s+the\s+following\s+groups?\b"
DESCRIPTIVE = (
    r"\b(?:signs?\s+(?:or|and)\s+)?symptoms?\s+(?:associated\s+with|of)\s+{t}\b",
    r"\bif\s+(?:signs?\s+(?:or|and)\s+symptoms?\s+of\s+)?{t}\b[^.;]{0,80}\b(?:occur|develop|emerge)\b",
)
DRUG_EFFECT = r"\b(?:cause[sd]?|causing|precipitate[sd]?|result(?:ed|s)?\s+in|associated\s+with|reported|occurred|observed)\b"
CLASS_STATEMENT = (
    r"\b(?:ssris?|snris?|statins?|beta[ -]?blockers?|beta[ -]?adrenergic\s+blockers?|ace\s+inhibitors?|angiotensin\s+receptor\s+blockers?|arbs?"
    r"|penicillins?|cephalosporins?|opioids?|benzodiazepines?)\b"
)
CLAUSE_BOUNDARY = r"(?:;\s*|,\s*(?:and|but|while|whereas)\s+)"
QUALITATIVE_BEFORE = r"(?<!\w){q}(?!\w)\s+(?:(?:cases?|events?|reports?)\s+of\s+)?(?<!\w){t}(?!\w)"
QUALITATIVE_AFTER = (
    r"(?<!\w){t}(?!\w)(?:[^.;]{0,60}?\b(?:reported|observed|seen|occurred|occurs|occurring)\b[^.;]{0,20}?"
    r"|\s+\b(?:is|are|was|were)\b\s+)(?<!\w){q}(?!\w)"
)
