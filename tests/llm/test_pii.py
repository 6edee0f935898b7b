"""Personal data against regular expressions and a round trip."""

from __future__ import annotations

import random
import re
import time

import pytest

import corpus_pipeline
from samebytes.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["1", "2", "55", ".", ".", "@", "-", " ", "a", "+", "(", ")", "4111111111111111", "b.c", "é", "%", "_", "0", "pwd=ab12cd34"]


def valid(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii.luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_kinds_agree_with_regular_expressions():
    anchors, some = pii.automaton(), random.Random(1)
    for _ in range(20_000):
        text = "".join(some.choice(PIECES) for _ in range(some.randint(0, 25)))
        expected = [
            (kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if valid(kind, m.group())
        ]
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.BASE_KINDS] == expected, text


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("iban: GB82 WEST 1234 5698 7654 32 ok", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("SSN is 123-45-6789.", "ssn", "123-45-6789"),
        ("password=b7db7aa4a5fc done", "secret", "b7db7aa4a5fc"),
        ("see https://joe:pw@host.example/x now", "url", "https://joe:pw@host.example/x"),
    ],
)
def test_added_kinds(text, kind, value):
    spans = [text[a:b] for k, a, b in pii.find_spans(text, pii.automaton()) if k == kind]
    assert spans == [value]


def test_awkward_rows_and_redaction(spark, awkward, no_docs):
    rows = pii.add_pii(awkward, clean="text").orderBy("doc_id").collect()
    assert len(rows) == awkward.count()
    last = next(r for r in rows if r.doc_id == 9)
    assert last.text == "mail me at [EMAIL] or [PHONE] \U0001f600"
    assert [r.pii for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert pii.add_pii(no_docs).count() == 0
    assert pii.redact("abcdef", [("email", 1, 4), ("url", 2, 5)]) == "a[EMAIL]f"


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ('x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y', "secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"),
        ('x TOKEN = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y', "secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"),
        ("PassWord: b7db7aa4a5fc done", "secret", "b7db7aa4a5fc"),
        ("client_secret=b7db7aa4a5fc done", "secret", "b7db7aa4a5fc"),
        ('{"auth": "b7db7aa4a5fc"}', "secret", "b7db7aa4a5fc"),
        ("Authorization: Bearer b7db7aa4a5fc done", "secret", "b7db7aa4a5fc"),
        ("\u0130\u1e9e ToKeN=b7db7aa4a5fc done", "secret", "b7db7aa4a5fc"),
        ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban", "DE89 3704 0044 0532 0130 00"),
        ("SSN 123-45-6789.", "ssn", "123-45-6789"),
        ("Social Security Number 123-45-6789.", "ssn", "123-45-6789"),
    ],
)
def test_cues_of_any_case_and_after_blanks(text, kind, value):
    assert [text[a:b] for k, a, b in pii.find_spans(text, pii.automaton()) if k == kind] == [value]


def test_cues_alone_are_no_secrets():
    for text in ("the token is wrong", "author: somebody1234", "IBAN DE00 3704 0044 0532 0130 00", "SSN 123456789", "a bearer of news"):
        assert not [s for s in pii.find_spans(text, pii.automaton()) if s[0] in pii.ADDED_KINDS], text


def test_pipeline_leaves_no_planted_token(spark):
    secrets = [f"{n:02d}ef4d6b2755a36d7d9c25bd72c4d5f67e061f{n:02d}" for n in range(20)]
    rows = [(n, f'{"TOKEN" if n % 2 else "token"} = "{s}" after', 0) for n, s in enumerate(secrets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clean = corpus_pipeline.redact_pii(spark, docs, "").collect()
    assert all(r.text.split(" = ")[1] == '"[SECRET]" after' for r in clean)


LONG = "a1B2-" * 4000


@pytest.mark.parametrize(
    "text, value",
    [
        (f"access_token={LONG} after", LONG),
        (f'access_token = "{LONG}" after', LONG),
        ("password: Tr0ub4dor#3xyz after", "Tr0ub4dor#3xyz"),
        ("password: p@ssw0rd123 after", "p@ssw0rd123"),
        ("password: 'corr3ct horse, \\'battery' after", "corr3ct horse, \\'battery"),
        ('password: "unclosed#1 after\n" end', "unclosed#1"),
        ('password=token="a1 b2c3d4e5" after', "a1 b2c3d4e5"),
    ],
)
def test_secrets_to_their_true_end(text, value):
    spans = pii.find_spans(text, pii.automaton())
    assert value in [text[a:b] for k, a, b in spans if k == "secret"]
    assert not set(re.findall(r"\w+", value)) & set(re.findall(r"\w+", pii.redact(text, spans)))


def test_urls_with_a_long_password():
    text = f"see https://joe:{'x' * 9000}@host.example/x now"
    assert [text[a:b] for k, a, b in pii.find_spans(text, pii.automaton()) if k == "url"] == [text[4:-4]]


@pytest.mark.parametrize("piece", ["password=", 'token="', "token='token=\"", "token=\\\"", "a://", "a://@", "a://b@", "secret is "])
def test_scan_stays_linear(piece):
    anchors, took = pii.automaton(), []
    for copies in (5_000, 40_000):
        start = time.process_time()
        pii.find_spans(piece * copies, anchors)
        took.append(time.process_time() - start)
    # Eight times the text; a square would take 64 times.
    assert took[1] < 24 * took[0] + 0.2
