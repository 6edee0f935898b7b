"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL schemes, plus
signs, digits and identifier cues such as `iban` or `password`. From every anchor a local
parser walks left and right, decides where the item begins and ends and validates it. Nothing
but the neighbourhood of an anchor is parsed.

Four base kinds follow a fixed contract (`email`, `ip`, `card`, `phone`); these spans come
first and are never changed. Added kinds: `iban` (mod 97), `ssn` and `secret` (value after an
identifier cue) and `url` (a URL that carries user information before its host).
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import ship

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret", "url")
KINDS = BASE_KINDS + ADDED_KINDS

#: What precedes the value of an account or a secret, in any case of A-Z.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    "social security number": "ssn",
    "password": "secret",
    "passwd": "secret",
    "passphrase": "secret",
    "pwd": "secret",
    "api_key": "secret",
    "api-key": "secret",
    "apikey": "secret",
    "secret_key": "secret",
    "access_key": "secret",
    "private_key": "secret",
    "auth_key": "secret",
    "access_token": "secret",
    "token": "secret",
    "secret": "secret",
    "credential": "secret",
    "credentials": "secret",
    "auth": "secret",
    "authorization": "secret",
    "bearer": "bearer",
}
#: Kinds whose value may follow its cue after blanks alone; a `bearer` value is a secret.
_BARE = frozenset(("iban", "ssn", "bearer"))

_DIGITS = frozenset(string.digits)
_ALNUM = frozenset(string.ascii_letters + string.digits)
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL = _ALNUM | frozenset("_-+/=.~!$%&*@:")
_SPACE = frozenset(" \t\r\n")
#: A value in quotes ends at the same quote on its line, any other value at white space.
_QUOTED = re.compile(r""""((?:[^"\\\r\n]++|\\.)*+)"|'((?:[^'\\\r\n]++|\\.)*+)'""")
_WORD = re.compile(r"\S*")

Span = tuple[str, int, int]


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at `at`."""
    end, size = at, len(text)
    while end < size and text[end] in allowed:
        end += 1
    return end


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn checksum."""
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`; its local part may not start before `floor`."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _run(text, end + 1, _LABEL)
        labels += 1
    return (start, end) if labels > 1 else None


def _ip(text: str, at: int) -> tuple[int, int, bool] | None:
    """Four dotted numbers from `at`, and whether each is at most 255."""
    end, fits = at, True
    for part in range(4):
        if part:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        begin, end = end, _run(text, end, _DIGITS)
        if begin == end:
            return None
        number = text[begin:end].lstrip("0")
        fits = fits and (len(number) < 3 or len(number) == 3 and number <= "255")
    return at, end, fits


def _card(text: str, at: int) -> tuple[int, int]:
    """Digits from `at`, with at most one blank or hyphen between two of them."""
    end, size = at + 1, len(text)
    while end < size:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < size and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return at, end


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """A number from the plus sign at `at` to the last digit of its run."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in _DIGITS else None


def _after_cue(text: str, at: int, bare: bool) -> int | None:
    """Where the value after a cue starts: past blanks, a quote that ends the cue, and one `:`, `=`, `#` or `is`.

    With `bare` blanks are enough.
    """
    after = _run(text, at, _SPACE)
    sign = _run(text, after + 1, _SPACE) if text[after : after + 1] in ("'", '"') else after
    if text[sign : sign + 1] and text[sign] in ":=#":
        return _run(text, sign + 1, _SPACE)
    if text[after : after + 3].lower() == "is ":
        return _run(text, after + 3, _SPACE)
    return after if bare and after > at else None


def _folded(text: str) -> str:
    """The text with A-Z lower-cased and nothing else, so that places stay the same."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number from `at`, in groups or not, that passes mod 97."""
    end, chars, best = at, [], None
    while end < len(text) and len(chars) < 34:
        if text[end] in _ALNUM:
            chars.append(text[end].upper())
            end += 1
            closed = end >= len(text) or text[end] not in _ALNUM
            if closed and 15 <= len(chars) and "".join(chars[:2]).isalpha():
                moved = "".join(chars[4:] + chars[:4])
                if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
                    best = (at, end)
        elif text[end] == " " and chars and end + 1 < len(text) and text[end + 1] in _ALNUM:
            end += 1
        else:
            break
    return best


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    """A number of the form 3-2-4 digits from `at`."""
    digits = [c for c in text[at : at + 11] if c in _DIGITS]
    end = at + 11
    shaped = len(digits) == 9 and text[at + 3 : at + 4] in ("-", " ") and text[at + 6 : at + 7] in ("-", " ")
    return (at, end) if shaped and (end >= len(text) or text[end] not in _ALNUM) else None


def _secret(text: str, at: int, parsed: int) -> tuple[tuple[int, int] | None, int]:
    """A value of eight characters or more with a letter and a digit, and how far text is parsed.

    A value without quotes that begins before `parsed` is the end of one that was looked at. A
    value in quotes may reach further: it goes to the next such quote, so no part of a text is
    in many of them.
    """
    quoted = _QUOTED.match(text, at)
    if quoted:
        start, end = quoted.span(quoted.lastindex)
    else:
        if at < parsed:
            return None, parsed
        start = at + (text[at : at + 1] in ("'", '"'))
        end = parsed = _WORD.match(text, start).end()
    value = text[start:end]
    if len(value) >= 8 and any(c in _DIGITS for c in value) and any(c.isalpha() for c in value):
        return (start, end), max(parsed, end)
    return None, parsed


def _user_url(text: str, at: int, anchor_end: int) -> tuple[tuple[int, int] | None, int]:
    """A URL with `user:password@host`, from its scheme to the end of the host, and how far text is parsed."""
    start = at
    while start > 0 and text[start - 1] in _ALNUM:
        start -= 1
    if start == at or text[anchor_end : anchor_end + 1] == "@":
        return None, at
    end = _run(text, anchor_end, _URL)
    host = text.find("@", anchor_end, end)
    # Without an at-sign in the run, or with one at its end alone, no later scheme in it has a host.
    return ((start, end) if anchor_end < host < end - 1 else None), end


def automaton():
    """Anchors of all kinds as one Aho-Corasick automaton, for texts with A-Z lower-cased."""
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "phone"), ("://", "url")):
        anchors.add_word(sign, (kind, len(sign)))
    for digit in string.digits:
        anchors.add_word(digit, ("number", 1))
    for cue, kind in CUES.items():
        anchors.add_word(cue, (kind, len(cue)))
    anchors.make_automaton()
    return anchors


def find_spans(text: str | None, anchors) -> list[Span]:
    """All spans of a text by kind and start, in code points; null text has none."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    ip_next, secret_at = 0, -1
    for last, (kind, size) in anchors.iter(_folded(text)):
        at = last - size + 1
        if kind == "number":
            # Only the first digit of a run is an anchor of its own for `ip`.
            if at >= ip_next and (at == ends["ip"] or at == 0 or text[at - 1] not in _DIGITS):
                ip = _ip(text, at)
                ip_next = ip[1] if ip else _run(text, at, _DIGITS)
                if ip:
                    ends["ip"] = ip[1]
                    if ip[2]:
                        found["ip"].append(ip[:2])
            if at >= ends["card"]:
                start, end = _card(text, at)
                ends["card"] = end
                if end - start >= 13:
                    digits = text[start:end].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((start, end))
        elif kind == "email":
            if at >= ends["email"]:
                span = _email(text, at, ends["email"])
                if span:
                    found["email"].append(span)
                    ends["email"] = span[1]
        elif kind == "phone":
            if at >= ends["phone"]:
                span = _phone(text, at)
                if span:
                    ends["phone"] = span[1]
                    if 9 <= sum(c in _DIGITS for c in text[span[0] : span[1]]) <= 15:
                        found["phone"].append(span)
        elif kind == "url":
            if at >= ends["url"]:
                span, ends["url"] = _user_url(text, at, last + 1)
                if span:
                    found["url"].append(span)
        elif kind in ("secret", "bearer"):
            value = _after_cue(text, last + 1, kind in _BARE)
            # Two cues may end at one place.
            if value is not None and value > secret_at:
                secret_at = value
                span, ends["secret"] = _secret(text, value, ends["secret"])
                if span:
                    found["secret"].append(span)
        else:
            value = _after_cue(text, last + 1, kind in _BARE)
            if value is not None and value >= ends[kind]:
                span = {"iban": _iban, "ssn": _ssn}[kind](text, value)
                if span:
                    found[kind].append(span)
                    ends[kind] = span[1]
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def redact(text: str, spans: list[Span]) -> str:
    """Replace spans by `[KIND]`; where spans overlap, one placeholder covers their union."""
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    parts, at = [], 0
    for kind, start, end in merged:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def add_pii(docs: DataFrame, text: str = "text", clean: str | None = None) -> DataFrame:
    """Documents with their personal data.

    Adds `pii`, an array of (kind, start, end) by kind and start; with `clean`, also the
    redacted text under that name (it may be the text column itself). Null and empty texts have
    an empty array and stay as they are. All other columns pass through; a column that is
    called `pii` already is replaced. Every row is handled alone and whole, repeated rows alike.
    """
    ship(docs.sparkSession)
    source = docs.drop("pii") if text != "pii" else docs

    @F.pandas_udf("struct<pii:array<struct<kind:string,start:bigint,end:bigint>>,clean:string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            spans = [find_spans(t, anchors) for t in batch]
            cleaned = [
                redact(t, s) if clean and s else t for t, s in zip(batch, spans, strict=True)
            ] if clean else [None] * len(spans)
            yield pd.DataFrame({
                "pii": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans],
                "clean": cleaned,
            })

    out = source.withColumn("_found", parse(F.col(text)))
    kept = [c for c in source.columns if c != clean]
    columns = [F.col(c) for c in kept] + [F.col("_found.pii").alias("pii")]
    if clean:
        columns.append(F.col("_found.clean").alias(clean))
    return out.select(*columns)
