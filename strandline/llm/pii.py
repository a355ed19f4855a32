r"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, schemes and identifier cues;
a deterministic parser of each kind expands an anchor to both sides and validates what it has. Addresses of four
numbers and card numbers have no sign of their own; their anchors are digits beside a full stop, and digits.

Kinds, in this order: email, ip, card, phone (the base: leftmost and non-overlapping per kind, see the patterns at each
parser), then what the method adds: url (scheme or `www.`, up to white space or a quote, trailing punctuation left out)
and account (the value after a cue such as `iban:`, `password=` or `token = "..."`).

A span counts code points, its end is exclusive. Defined cases: a null text counts as empty, and an empty text has no
spans; very long runs of digits or letters are parsed in linear time; repeated rows get equal results; an empty table
gives an empty result; other columns stay out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Fixed cues of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("iban", "account", "acct", "password", "passwd", "token", "secret", "api_key", "apikey", "ssn", "username", "userid", "user_id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*+")
_URL = re.compile(r"[^\s\"'<>]+")
_SIGN = re.compile(r"(?: (?:number|no|nr|id))?\.?\s{0,3}[=:#]?\s{0,3}[\"']?")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9A-Za-z])")
_SSN = re.compile(r"[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\s\"',;&#]{4,}")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in ("@", "+", *SCHEMES, *CUES):
        a.add_word(cue, cue)
    for x in "0123456789":
        a.add_word(x + ".", "ip")
        for y in "0123456789 -":
            a.add_word(x + y, "card")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        x = ord(ch) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    r"""`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` around the at-sign, not before floor."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def phone(text: str, plus: int) -> tuple[int, int] | None:
    r"""`\+[0-9][\x20().0-9-]+[0-9]` from the plus sign, 9 to 15 digits."""
    m = _PHONE.match(text, plus)
    if not m:
        return None
    end = m.end()
    while not "0" <= text[end - 1] <= "9":
        end -= 1
    if end - plus < 4:
        return None
    return (plus, end) if 9 <= sum("0" <= c <= "9" for c in text[plus:end]) <= 15 else None


def iban(value: str) -> bool:
    """15 to 34 characters whose rearranged number is 1 modulo 97."""
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """The value that a cue names, by the cue's grammar: an IBAN that adds up, 6 to 20 digits of an account, 9 digits of a
    social security number; for names and secrets, which need a sign of assignment, a word with a digit or inner sign,
    for secrets of 6 characters and two kinds of them at least."""
    sign = _SIGN.match(text, at)
    start = sign.end()
    if cue == "iban":
        m = _IBAN.match(text, start)
        for end in range(m.end() if m else start, start + 14, -1):  # words may follow; the longest that adds up
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and iban(text[start:end]):
                return start, end
        return None
    if cue in ("account", "acct"):
        m = _NUMBER.match(text, start)
        return (start, m.end()) if m else None
    if cue == "ssn":
        m = _SSN.match(text, start)
        return (start, m.end()) if m else None
    m = _WORD.match(text, start) if any(c in sign[0] for c in "=:#") else None
    if not m:
        return None
    value = m[0].rstrip(".!?)]}")
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    name = cue.startswith("user")
    good = len(value) >= 4 and any(c.isdigit() or c in "._-" for c in value) if name else len(value) >= 6 and kinds >= 2 and any(not c.isalpha() for c in value)
    return (start, start + len(value)) if good else None


_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans, sorted."""
    out: list[tuple[int, int, int]] = []
    floor, ips, cards, cover = 0, 0, 0, [0] * len(KINDS)
    low = text.lower()
    if len(low) != len(text):  # some letters change length
        low = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).decode("utf-8", "surrogatepass")
    for last, cue in automaton.iter(low):
        if cue == "@":
            found = email(text, last, floor)
            if found:
                floor = found[1]
                out.append((found[0], 0, found[1]))
        elif cue == "+":
            found = phone(text, last)
            if found:
                out.append((found[0], 3, found[1]))
        elif cue in SCHEMES:
            start = last - len(cue) + 1
            if start >= cover[4]:
                m = _URL.match(text, last + 1)
                if m:
                    end = last + 1 + len(m[0].rstrip(".,;:!?)]}*%&#$"))
                    if end > last + 1:
                        cover[4] = end
                        out.append((start, 4, end))
        elif cue == "ip":
            if last > ips:
                start = last - 1
                while start > ips and "0" <= text[start - 1] <= "9":
                    start -= 1
                m = _IP.match(text, start)
                ips = m.end() if m else last
                if m and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        elif cue == "card":
            if last > cards:  # the first two characters of a run
                m = _CARD.match(text, last - 1)
                cards = m.end()
                if m.end() - m.start() >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((m.start(), 2, m.end()))
        else:
            start = last - len(cue) + 1
            if (start == 0 or not text[start - 1].isalnum()) and last + 1 >= cover[5]:
                m = account(text, cue, last + 1)
                if m:
                    cover[5] = m[1]
                    out.append((m[0], 5, m[1]))
    return sorted(out)


def spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256, spans."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            count: list[list[int]] = [[] for _ in KINDS]
            sha, every = [], []
            for text in b.column("text").to_pylist():
                found = find(text, automaton) if text else []
                for k, c in enumerate(count):
                    c.append(sum(x[1] == k for x in found))
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                sha.append(hashlib.sha256(",".join(x for x, f in zip(said, found) if f[1] < len(BASE)).encode()).hexdigest())
                every.append(",".join(said))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return spans(common.table(spark, sf_dir, "documents"))
