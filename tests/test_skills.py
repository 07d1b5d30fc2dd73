import pytest
from pyspark.sql import functions as F

from jobtide.operators import records, reports, skills


@pytest.mark.parametrize("raw, expected", [
    ("Identity and Access Management (IAM)", "iam"), ("Access Management", "identity and access management"),
    ("IT Security Ops", "security operations"), ("SecOps", "security operations"), ("IT Ops", "it operations"),
    ("TCP/IP", "tcp ip"), ("Internet Protocol Suite", "tcp/ip"), ("Amazon Web Services (AWS)", "aws"),
    ("Office 365", "microsoft 365"), ("C++", "c++"), ("C#", "c#"), (".NET", ".net"), ("R&D", "r and d"),
    ("Café", "cafe"), ("Malmø", "malm"), ("Python (Programming Language)", "python"),
    ("Threat & Vulnerability Management", "threat and vulnerability management"),
    ("  Cloud — Native ", "cloud native"), ("A (b) (c)", "a b"),
])
def test_normalise_token(one, raw, expected):
    assert one(skills.normalise_token, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("Identity (IAM)", "iam"), ("Python (Programming Language)", None), ("SQL", None), ("X (é!)", None), ("Card (PCI.DSS)", "pci.dss"),
])
def test_alias(one, raw, expected):
    assert one(skills.token_alias, raw) == expected


def test_split(one):
    assert one(skills.split_skills, "a, b ,,c") == ["a", "b", "c"]
    assert one(skills.split_skills, None) is None


def test_noise(one):
    assert one(records.is_noise_token, "1 of 8 skill matches your profile") is True
    assert one(records.is_noise_token, "3 of 8 skills match your profile") is False
    assert one(records.is_noise_token, " ") is True


def tokens(spark, rows):
    return skills.explode_skills(spark.createDataFrame(rows, "id long, skill string"))


def test_excluded_and_split_terms(spark):
    got = tokens(spark, [(1, "Cyber-security, cyber, English (B2), Governance, risk management, and compliance"), (2, None), (3, "")])
    assert [(r["pos"], r["normalized_skill"]) for r in got.orderBy("pos").collect()] == [
        (3, "governance"), (4, "risk management"), (5, "and compliance"),
    ]


def test_bridge_keeps_first_spelling(spark):
    t = tokens(spark, [(1, "Python, python"), (2, "PYTHON, Café")])
    dim = skills.skill_dim(t)
    assert [tuple(r) for r in dim.orderBy("id").collect()] == [(1, "cafe"), (2, "python")]
    rows = sorted(tuple(r) for r in skills.job_skill(t, dim).collect())
    assert rows == [(1, 2, "Python"), (2, 1, "Café"), (2, 2, "PYTHON")]


def test_extending_the_dimension_keeps_ids(spark):
    old = spark.createDataFrame([(7, "python")], "id long, normalized_skill string")
    t = tokens(spark, [(1, "Python, SQL, Go")])
    rows = sorted(tuple(r) for r in skills.extend_skill_dim(old, t).collect())
    assert rows == [(7, "python"), (8, "go"), (9, "sql")]


def test_raw_tokens(spark):
    df = spark.createDataFrame([("a,b,",), ("",), (None,), (" A ,c",)], "skill string")
    assert skills.raw_token_total(df).first()[0] == 5
    assert skills.distinct_raw_tokens(df).first()[0] == 3


def test_frequency(spark):
    bridge = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "job_posting_id long, normalized_skill string")
    postings = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(r["normalized_skill"], r["occurrences"], r["label_suffix"]) for r in reports.skill_frequency(bridge, postings).collect()]
    assert rows == [("a", 2, 66.67), ("b", 1, 33.33)]
    assert reports.skill_frequency(bridge, postings.limit(0)).first()["frequency"] == 0.0


def test_country_may_be_empty_text(spark):
    bridge = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "job_posting_id long, normalized_skill string")
    postings = spark.createDataFrame([(1, ""), (2, None), (3, "Italy"), (4, "Italy")], "id long, country string")
    every = reports.demand_by_country(bridge, postings, 5, None)
    assert sorted((r["country"], r["total_postings"], r["frequency"]) for r in every.collect()) == [("", 1, 1.0), ("Italy", 2, 0.5)]
    assert [r["country"] for r in reports.demand_by_country(bridge, postings).collect()] == ["Italy"]
    assert [r["country"] for r in reports.country_summaries(every).collect()] == ["Italy", ""]


def test_map_classes(spark):
    totals = spark.createDataFrame([("Czechia", 100), ("Italy", 50), ("Malta", 1)], "country string, total_postings long")
    names = spark.createDataFrame([("Czech Republic",), ("Italy",), ("Malta",), ("Spain",)], "map_name string")
    levels = {r["map_name"]: r["level"] for r in reports.map_classes(totals, names).collect()}
    assert levels == {"Czech Republic": 3, "Italy": 2, "Malta": 1, "Spain": 1}
    assert {r["level"] for r in reports.map_classes(totals.limit(0), names).collect()} == {0}
    assert tuple(reports.legend_bounds(totals).first()) == (33, 66, 100)


def test_hot_skill_and_posting(spark):
    """A third of all rows on one skill, a third on one posting: counts stay whole."""
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") < n / 3, 7).otherwise(F.col("id")).alias("job_posting_id"),
        F.when(F.col("id") >= 2 * n / 3, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("normalized_skill"),
    )
    counts = {r[0]: r[1] for r in reports.skill_counts(rows).collect()}
    assert counts["hot"] == 1000 and len(counts) == 2001 and sum(counts.values()) == 3000
