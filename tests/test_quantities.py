import duckdb

from labelloom.operators.quantities import found_sql, normalize_quantities

P, R = "proportion", "rate"
CASES = [
    ("5%", None, None, P, 50000),
    ("approximately 0.25 per cent", None, None, P, 2500),
    ("0,1 %", None, None, P, 1000),
    ("(1.7% of patients)", None, None, P, 17000),
    ("5‰", None, None, P, 5000),
    ("3 per mille", None, None, P, 3000),
    ("proportion of 0.073", None, None, P, 73000),
    ("0.268 (fraction of patients)", None, None, P, 268000),
    ("two of 331 patients", None, None, P, 6042),
    ("n=754 (N=7413)", None, None, P, 101713),
    ("1 in 12 000", None, None, P, 83),
    ("1:8", None, None, P, 125000),
    ("1/128", None, None, P, 7813),
    ("35 (patients) among 1,301", None, None, P, 26902),
    ("62 events per 10000 patients", None, None, P, 6200),
    ("0.8 per 100 000 patient-years of exposure", None, None, R, 80),
    ("65 events per 100 patient-months", None, None, R, 78000000),
    ("11.0 cases per 1000 PY", 99.0, "percent", R, 110000),
    (None, 2.5, "PERCENT", P, 25000),
    ("  ", 3.0, "of 65 patients", P, 46154),
    (None, 19000.0, "ppm", P, 19000),
    (None, 1.0, "in 250", P, 4000),
    (None, 7.0, "per 1000 person-years", R, 70000),
    (None, 7.0, None, None, None),
    (None, None, "percent", None, None),
    (None, -1.0, "percent", None, None),
    (None, float("nan"), "percent", None, None),
    (None, 1e300, "percent", None, None),
    ("1% to 6%", None, None, None, None),
    ("<1%", None, None, None, None),
    ("12 patients", None, None, None, None),
    ("10 mg/day", None, None, None, None),
    ("1% cream", None, None, None, None),
    ("110/60 mmHg", None, None, None, None),
    ("120/80", None, None, None, None),
    ("3 of 0 patients", None, None, None, None),
    ("2-fold increase", None, None, None, None),
    ("not reported", 5.0, "percent", None, None),
    ("", None, None, None, None),
    ("7" * 100_000, None, None, None, None),
    ("1" + ",234" * 50_000 + " of 3", None, None, None, None),
    ("(" * 50_000 + "5%", None, None, None, None),
    ("5" + " " * 100_000 + "%" + "\t" * 500, None, None, P, 50000),
    ("approximately " + "\u00a0" * 400 + "2.5 % of patients", None, None, P, 25000),
    (None, 2e12, "per 1000 patient-years", R, 20000000000000000),
    (None, 9e17, "per 1000 patient-years", None, None),
    (None, float("inf"), "percent", None, None),
    ("123456789012345678 per 1000 PY", None, None, None, None),
    ("900000000000 of 900000000000 patients", None, None, P, 1000000),
    (None, None, None, None, None),
]


def test_cases_and_sql(spark):
    rows = [(i, t, v, u, "x") for i, (t, v, u, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "item_id bigint, frequency_text string, frequency_value double, frequency_unit string, q_extra string")
    got = {r.item_id: (r.quantity, r.value_e4, r.q_extra) for r in normalize_quantities(df, "frequency_text", "frequency_value", "frequency_unit").collect()}
    for i, (t, v, u, q, e) in enumerate(CASES):
        assert got[i] == (q, e, "x"), (t, v, u)
    evidence_item = df.toPandas()  # noqa: F841
    sql = {(r[0], r[1], r[2]) for r in duckdb.sql(found_sql()).fetchall()}
    assert sql == {(i, q, e) for i, (_, _, _, q, e) in enumerate(CASES) if q}


def test_default_unit_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, 2.0, " ")] * 2, "t string, v double, u string")
    assert [r.value_e4 for r in normalize_quantities(df, "t", "v", "u", "percent").collect()] == [20000, 20000]
    assert normalize_quantities(df.limit(0), "t", "v", "u").count() == 0


def test_written_forms_against_the_numbers_they_were_written_from(spark):
    """Forms put together from known numbers; the value is worked out from these, not read from the text."""
    import random
    from fractions import Fraction

    pick = random.Random(8)
    group = lambda n, mark: f"{n:,}".replace(",", mark)
    people = ("patients", "persons", "subjects", "participants", "cases", "people")
    words = dict(zip("one two three four five six seven eight nine ten".split(), range(1, 11), strict=True))
    cases = []
    for _ in range(1500):
        a, b = pick.randrange(1, 500), pick.randrange(500, 90_000)
        tenth = pick.randrange(1, 1000)
        lead = pick.choice(["", "approximately ", "About ", "~", "ca. "])
        who = pick.choice(people)
        number = pick.choice([f"{tenth / 10:.1f}", f"{tenth / 10:.1f}".replace(".", ",")])
        word = pick.choice(list(words))
        share = [
            (f"{lead}{number}{pick.choice(['%', ' %', ' percent', ' per cent', ' pct'])}", Fraction(tenth, 10)),
            (f"{lead}{a} {pick.choice(['of', 'out of', 'among', 'in'])} {group(b, pick.choice(['', ',', ' ']))} {who}", Fraction(100 * a, b)),
            (f"{a} {who} per {group(b, ',')}", Fraction(100 * a, b)),
            (f"n={a} (N={b})", Fraction(100 * a, b)),
            (f"{word} in {b}", Fraction(100 * words[word], b)),
            (f"{a}/{b}", Fraction(100 * a, b)),
            (f"{pick.choice(['proportion', 'fraction'])} of 0.{tenth:03d}", Fraction(tenth, 10)),
            (f"{number}‰", Fraction(tenth, 100)),
        ]
        scale, unit = pick.choice([(1, "years"), (12, "months")])
        rate = [(f"{lead}{a} {pick.choice(['events', 'cases', 'patients'])} per {group(b, pick.choice(['', ',']))} {pick.choice(['patient', 'person', 'subject'])}-{unit}", Fraction(1000 * a * scale, b))]
        text, value = pick.choice(share + rate)
        quantity = R if (text, value) in rate else P
        if quantity == P and value > 100:
            continue
        e4 = int((2 * value * 10_000 + 1) // 2)
        cases.append((pick.choice([text, text.upper(), f" {text} ", f"({text})"]), quantity, e4))
    df = spark.createDataFrame([(i, t, None, None) for i, (t, _, _) in enumerate(cases)], "i int, t string, v double, u string")
    got = {r.i: (r.quantity, r.value_e4) for r in normalize_quantities(df, "t", "v", "u").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(cases) if got[i] != c[1:]]
    assert not wrong, wrong[:10]
