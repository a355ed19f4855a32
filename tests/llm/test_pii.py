import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import pii


def brute(text):
    """The base patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


A = pii._automaton()


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab@.-1+ ", max_size=40), st.text("0123456789 -.+()", max_size=60), st.text("aé@.19+-_%İ\n", max_size=40)))
def test_base_spans_are_those_of_the_patterns(text):
    assert [x for x in pii.find(text, A) if x[1] < 4] == brute(text)


def test_long_runs_take_linear_time():
    assert pii.find("7" * 2_000_000 + "." * 10, A) == []
    assert pii.find("a" * 2_000_000 + "@", A) == []


def test_added_kinds():
    text = 'see https://a.example/x?y=1, token = "abcd1234" iban: DE89 3704 0044 0532 0130 00 is, account no. 12345678, ssn 123-45-6789 username: jo.b'
    kinds = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find(text, A)]
    want = [("url", "https://a.example/x?y=1"), ("account", "abcd1234"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("account", "123-45-6789"), ("account", "jo.b")]
    assert [x for x in kinds if x[0] in ("url", "account")] == want


def test_cues_without_a_value_name_nothing():
    for text in ("On account: because he left", "the token: something else", "iban: DE00 0000 1234", "password: hunter", "secret=abc", "an account of 12 things", "iban DE89 3704 0044 0532 0130 01", "username: somebody"):
        assert pii.find(text, A) == [], text


def test_nulls_empties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "mail a@b.co now", None), (3, "a@b.co", "q"), (3, "a@b.co", "q")], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.spans) for r in pii.spans(df).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (None, 1, "email:5:11"), (3, 1, "email:0:6")}
    assert pii.spans(df.limit(0)).count() == 0


def test_a_letter_that_grows_costs_no_span():
    text = "PASSWORD: Hunter22! WWW.site.org"
    want = pii.find(text, A)
    assert len(want) == 2 and pii.find("İ " + text, A) == [(s + 2, k, e + 2) for s, k, e in want]
