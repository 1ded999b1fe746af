"""Literal values for the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from screenforge.constants import DEFAULT_WEIGHTS, ROLE_WEIGHTS
from screenforge.functions import contacts, dates, experience, literals, replies, text, vectors


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("out")).collect()]


def test_parse_experience(spark):
    table = {
        "3": 3.0, "3+ years": 3.0, "about 4": 4.0, "1.2.3": 1.2, "2 years 5 months": 2.42, "Fresher": 0.0,
        "N/A": 0.0, "-": 0.0, "": 0.0, "  ": 0.0, "['4', '2']": 4.0, "2.": 2.0, "5 months": 5.0,
        "10 months 2 years": 10.17, "-3": 3.0, " Freshers ": 0.0, "none": 0.0, "NaN": 0.0, "no idea": 0.0,
        "2.345": 2.35, "1 MONTH 6": 1.5,
    }
    assert values(spark, experience.parse_experience, [*table, None]) == [*table.values(), 0.0]


def test_numeric_experience(spark):
    assert values(spark, experience.numeric_experience, [-3.0, float("nan"), None, 2.345], "double") == [-3.0, 0.0, 0.0, 2.345]


def test_clean_experience_by_type(spark):
    numbers = spark.createDataFrame([(2,), (None,)], "experience int")
    lists = spark.createDataFrame([(["4", "2"],), (None,)], "experience array<string>")
    assert [r[0] for r in experience.clean_experience(numbers).collect()] == [2.0, 0.0]
    assert [r[0] for r in experience.clean_experience(lists).collect()] == [4.0, 0.0]


AS_OF = dt.date(2026, 4, 1)


@pytest.mark.parametrize(
    ("job", "years"),
    [
        ("2019 to Present", 7.0),
        ("June 2019 to Present", 6.83),
        ("Jan 2018 to Dec 2020", 3.0),
        ("2 years 5 months", 2.42),
        ("3+ years", 3.0),
        ("Engineer at X (Sept. 2019 – Till Present)", 6.58),
        ("2015 - 2018", 3.0),
        ("6 months", 0.5),
        ("Jan 2018 to Dec 2020 (3 years)", 3.0),
        ("Dec 2020 to Jan 2018", 0.0),
        ("3 years\n2 years\n1 year\n2 years\n2 years", 10.0),
    ],
)
def test_work_history(spark, job, years):
    resume = f"A B\nSummary\n20 years experience\nWork Experience\n{job}\nEducation\n1990 to 1995\n"
    assert values(spark, lambda c: experience.work_history_years(c, AS_OF), [resume]) == [years]


def test_work_history_sections(spark):
    both = "Work Experience:\n2 years\nSkills\nSQL 9 years\nEMPLOYMENT HISTORY\n3 years"
    windows = "WORK HISTORY\r\n2019 to Current\r\n\r\nEDUCATION\r\n1990 to 1999\r\n"
    inputs = [both, "Summary\n5 years of experience", None, "", windows]
    assert values(spark, lambda c: experience.work_history_years(c, AS_OF), inputs) == [5.0, 0.0, 0.0, 0.0, 7.0]


def test_work_history_long_text(spark):
    filler = "lorem ipsum\n" * 50_000
    resume = f"{filler}Work Experience\n{filler}3 years\n{filler}Education\n{filler}"
    assert values(spark, lambda c: experience.work_history_years(c, AS_OF), [resume]) == [3.0]


def test_parse_list_literal(spark):
    table = {
        "['a', 'b']": ["a", "b"], '["a", \'b\']': ["a", "b"], "[]": [], "['it\\'s', \"x'y\"]": ["it's", "x'y"],
        "'sql'": ["sql"], '"sql"': ["sql"], "('a', 'b')": ["('a', 'b')"], "{'a': 1}": ["{'a': 1}"], "42": ["42"],
        "sql, java": [], "nan": [], "": [], "['a'": [], "['a'] tail": [], "['a'], ['b']": [], "[1, 2.5]": ["1", "2.5"],
        "['None', 'x']": ["None", "x"], "[None, 'x', True]": [None, "x", "True"], "['a',]": ["a"], "True": ["True"],
        "['a\\\\b']": ["a\\b"], "['a, None, b']": ["a, None, b"],
    }
    assert values(spark, literals.parse_list_literal, [*table, None]) == [*table.values(), []]


def test_format_list_literal(spark):
    inputs = [["a", "b"], [], None, ["it's"], ["\"it's\""], ["a\\b\nc"], [None]]
    expected = [repr(v) if v is not None else "[]" for v in inputs]
    assert values(spark, literals.format_list_literal, inputs, "array<string>") == expected
    back = values(spark, lambda c: literals.parse_list_literal(literals.format_list_literal(c)), inputs, "array<string>")
    assert back == [v or [] for v in inputs]


def test_text(spark):
    assert values(spark, text.resolve_role, ["QA", "Developer", " qa", None]) == ["testing", "developer", " qa", None]
    assert values(spark, text.email_key, [" A@B.c\n", "", "  ", None]) == ["a@b.c", None, None, None]
    assert values(spark, text.split_skills, ["a,,B ", " ", "", ","]) == [["a", "", "b"], [], [], ["", ""]]
    assert values(spark, text.title_case, ["data_engineer", "they're 3rd-CLASS", ""]) == [
        "Data_Engineer", "They'Re 3Rd-Class", "",
    ]
    assert values(spark, text.valid_email, ["a@b", "ab", "", None]) == [True, False, False, False]
    assert values(spark, text.file_format, ["a.pdf", "a.PDF", "a.jpeg", "a.odt", "pdf"]) == [
        "pdf", "unknown", "image", "odt", "unknown",
    ]
    assert values(spark, text.skill_count, [["a", "a"], [], None], "array<string>") == [2, 0, 0]
    assert values(spark, text.escape_html, ['<a href="x">&</a>']) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"]


def test_dates(spark):
    assert values(spark, dates.format_interview_date, ["2025-05-05", "2025-5-5", "2025-02-30", "05/05/2025", "", None]) == [
        "Monday, 05 May 2025", "Monday, 05 May 2025", None, None, None, None,
    ]
    assert values(spark, dates.format_interview_time, ["10:30", "0:05", "23:59", "24:00", "noon", None]) == [
        "10:30 AM", "12:05 AM", "11:59 PM", None, None, None,
    ]


def test_clean_json(spark):
    inputs = ['```json\n{"a": 1}\n```', 'x {"a": {"b": 1}} y } z', "  none \n", None]
    assert values(spark, replies.clean_json, inputs) == ['{"a": 1}', '{"a": {"b": 1}} y }', "none", None]


def test_parse_reply(spark):
    good = '{"name": "A", "skills": ["x", "y"], "experience": 2.5, "location": null}'
    bad = [good[:-3], good + " and " + good, good + "," + good, "[1]", "text", "{'name': 'A'}", "", None]
    out = values(spark, replies.parse_reply, [good, '{"error": "quota"}', *bad])
    assert (out[0].name, out[0].skills, out[0].experience, out[0].location, out[0].error) == ("A", '["x","y"]', "2.5", None, None)
    assert out[1].error == "quota" and out[1].name is None
    assert [r.error for r in out[2:]] == [replies.PARSE_ERROR] * len(bad)


def test_contacts(spark):
    resume = "\n  Ann B. Example \nMobile no: (030) 123-456 78\nCity: Köln \nann.b@mail.example.org.\nTel 0000000000"
    assert values(spark, contacts.contact_name, [resume, " \n", None]) == ["Ann B. Example", None, None]
    assert values(spark, contacts.contact_location, [resume, "no"]) == ["Köln", None]
    assert values(spark, contacts.contact_email, [resume, "a@b"]) == ["ann.b@mail.example.org", None]
    assert values(spark, contacts.contact_phone, ["call +49 30 1234567 now", "12", resume]) == ["+49 30 1234567", None, "(030) 123-456 78"]
    assert values(spark, contacts.listed_skills, ["Skills\n* SQL, Java; SQL\n- C++ | R\n\nEducation\nx", "no"]) == [
        ["SQL", "Java", "C++", "R"], [],
    ]


def test_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])],
        "a array<float>, b array<float>",
    )
    out = [r[0] for r in df.select(F.round(vectors.cosine100(F.col("a"), F.col("b")), 4)).collect()]
    assert out == [70.7107, -100.0, 0.0, None]


def test_weights_sum_to_100():
    assert all(sum(w) == 100 for w in [*ROLE_WEIGHTS.values(), DEFAULT_WEIGHTS])
