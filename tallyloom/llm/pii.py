"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, URI schemes and identifier cues.  A deterministic local
parser starts at each anchor, expands to the boundaries of the candidate and validates it.  Numbers carry no literal
anchor, so their anchors are digits and plus signs.  No parser looks beyond the run of characters that its kind allows
and none backs up, so time is linear in the text however long its runs are.

Kinds ``email ip card phone`` are the base: leftmost non-overlapping matches of the public patterns below, then
validated.  The method adds ``account`` (an IBAN that passes mod 97, or an identifier of at least five digits after a
cue), ``address`` (an e-mail or host address inside a URI, scheme and user part included), and ``secret`` (what is
assigned to a password, or a long run of mixed letters and digits behind the name of a key or token).  Added spans
never remove or change base spans.

Rules for odd rows: a null text is an empty one; an empty text has no spans; offsets are code points, end exclusive;
equal rows get equal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "secret")

# Anchors by role.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "sip:", "xmpp:")
CUES = (
    "account", "acct", "iban", "ssn", "social security", "passport", "licence no", "license no", "tax id", "customer id",
    "member id", "employee id", "konto", "kontonummer", "steuernummer", "compte", "cuenta", "número de cuenta", "dni", "nif",
)
SECRETS = ("token", "secret", "api key", "apikey", "api_key", "access key", "access_key", "private key", "private_key", "bearer")
PASSWORDS = ("password", "passwd", "passphrase", "pwd", "passwort", "kennwort", "mot de passe", "contraseña")
KEY_LENGTH, KEY_DIGITS = 16, 3  # a key has that many characters at least, and that many of these are digits
CUE_REACH = 24  # code points between a cue and the identifier that it announces
ACCOUNT_DIGITS = (5, 34)
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_URI = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:@-]+")
_IDENT = re.compile(r"[A-Za-z0-9](?:[ ./-]?[A-Za-z0-9])*")
_ASSIGNED = re.compile(r"""["'`\])]{0,2}\s{0,3}(?P<sign>=>|:=|[:=])?\s{0,3}["'`]?(?P<value>[A-Za-z0-9+/_.~=-]+)""")
_DIGIT = re.compile(r"[0-9]")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton over lower-cased text; values are ``(role, length)``."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    for c in SECRETS:
        a.add_word(c, ("secret", len(c)))
    for c in PASSWORDS:
        a.add_word(c, ("password", len(c)))
    a.make_automaton()
    return a


def _secret(text: str, at: int, password: bool) -> tuple[int, int] | None:
    """What stands behind the name of a secret: anything assigned to a password, else a run that looks like a key."""
    m = None if text[at : at + 1].isalnum() else _ASSIGNED.match(text, at)
    if not m:
        return None
    start, value = m.start("value"), m["value"].rstrip(".")
    if password and m["sign"]:
        return (start, start + len(value)) if len(value) >= 4 else None
    digits = sum("0" <= c <= "9" for c in value)
    return (start, start + len(value)) if len(value) >= KEY_LENGTH and KEY_DIGITS <= digits < len(value) else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(text: str) -> bool:
    if not (15 <= len(text) <= 34 and text[:2].isalpha() and text[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign to both sides, not left of ``floor``; two labels at least on the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _HOST.match(text, at + 1)) or "." not in m[0]:
        return None
    return start, m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, taken four at a time from the left."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        end = m.end()
        while not text[end - 1].isdigit() or text[end - 1] > "9":
            end -= 1
        n = sum("0" <= c <= "9" for c in text[m.start() : end])
        # The shortest match has a digit, one more character and a digit.
        if end - m.start() >= 4 and PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
            yield m.start(), end


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The first identifier with a digit within reach behind a cue."""
    stop = min(len(text), at + CUE_REACH)
    m = _DIGIT.search(text, at, stop)
    if not m:
        return None
    start = m.start()
    while start > at and text[start - 1].isalnum() and text[start - 1].isascii():
        start -= 1
    run = _IDENT.match(text, start, min(len(text), start + 3 * ACCOUNT_DIGITS[1]))
    if not run:
        return None
    end = run.end()
    bare = re.sub(r"[ ./-]", "", run[0])
    if iban(bare.upper()):
        return start, end
    token = re.match(r"[A-Za-z0-9./-]*[A-Za-z0-9]", run[0])
    digits = sum("0" <= c <= "9" for c in token[0]) if token else 0
    return (start, start + token.end()) if ACCOUNT_DIGITS[0] <= digits <= ACCOUNT_DIGITS[1] else None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of ``text`` by kind as listed, then start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    lower = text.lower()
    if len(lower) != len(text):  # a capital whose lower case is two code points would shift offsets
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    floor = 0
    for last, (role, size) in anchors().iter(lower):
        if role == "at":
            if (last >= floor) and (m := _email(text, last, floor)):
                found["email"].append(m)
                floor = m[1]
        elif role == "scheme":
            m = _URI.match(text, last + 1)
            host = m and m[0].rpartition("@")[2].split(":")[0]
            if host and (h := _HOST.match(host)) and "." in h[0] and "@" in m[0]:
                start = last + 1 - size
                if not found["address"] or found["address"][-1][1] <= start:
                    found["address"].append((start, m.end()))
        elif role in ("secret", "password"):
            if (m := _secret(text, last + 1, role == "password")) and (not found["secret"] or found["secret"][-1][1] <= m[0]):
                found["secret"].append(m)
        elif lower[last + 1 : last + 2].isalpha() or last >= size and lower[last - size].isalpha():
            continue  # a cue inside a longer word
        elif m := _account(text, last + 1):
            if not found["account"] or found["account"][-1][1] <= m[0]:
                found["account"].append(m)
    found["ip"] += _ips(text)
    found["card"] += _cards(text)
    found["phone"] += _phones(text)
    return [(k, s, e) for k, own in found.items() for s, e in own]


def digest(found: list[tuple[str, int, int]]) -> tuple:
    """Counts of the base kinds, SHA-256 of the base spans, all spans as text."""
    counts = [sum(k == kind for k, _, _ in found) for kind in BASE]
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in found if k in BASE)
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in found))


def redact(text: str | None, mask: str = "[{kind}]") -> str:
    """``text`` with every span replaced; of overlapping spans the one that starts first (longer first) counts."""
    text, out, at = text or "", [], 0
    for kind, s, e in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mask.format(kind=kind)]
            at = e
    return "".join([*out, text[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    for b in batches:
        cols = list(zip(*(digest(spans(t)) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row of ``docs``; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests, out)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t) for t in b.column(1).to_pylist()], pa.string())], ["id", "text"])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with every span replaced by its kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_redacted, f"id {kind}, text string")
