"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs,
plus signs, digits, URL schemes, identifier cues, and the openings and names
of secrets.  From each anchor a deterministic local parser expands to both
sides, finds the boundaries and validates.  Kinds:

- ``email``, ``ip``, ``card``, ``phone``: the base kinds, leftmost and not
  overlapping within a kind; a match that fails its check is dropped and the
  search goes on after it;
- ``url``: an address with user data, ``scheme://user[:password]@host...``;
- ``account``: after a cue (IBAN, account, acct, SSN), an IBAN with a valid
  mod-97 check, or 6 to 20 digits with single spaces or hyphens between them;
  after passport, licence or license and a word for number, 6 to 15 capitals
  and digits with at least 4 digits; without a cue, a social security number
  ``ddd-dd-dddd`` whose area, group and serial are in use;
- ``secret``: a key with a published opening (``_KEYS``); a private-key block,
  to its end line or, without one, to the end of its base64 lines; a bearer
  token; and the value given to a name such as password, token or api_key
  after ``=`` or ``:``, at least 8 characters with a letter and a digit (so
  prose such as "token: expired" is none).

Spans are code points, end exclusive.  A document is read on its own and
whole (no shuffle).  A null or empty text has no spans; repeated rows give
equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@]+@[^\s/?#@]+[^\s]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")
_GAP = re.compile(r"[ :#.]{0,3}(?:(?:no|nr|number)[ :#.]{0,3})?", re.I)

_PAPER = re.compile(r"[ ]?(?:no|nr|number|#)[ :#.]{0,3}([A-Z0-9]{6,15})(?![A-Za-z0-9])", re.I)
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9]|-[0-9])")
_GIVEN = re.compile(r"""["']?[ \t]{0,3}(?:=>|:=|[=:])[ \t]{0,3}["']?([^\s"'<>,;]{8,})""")
_BEARER = re.compile(r" ([A-Za-z0-9._~+/-]{20,}=*)")
_BLOCK = re.compile(r"[A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:\s*[A-Za-z0-9+/=]{16,})*")

# The published openings of access keys, and what follows them
_KEYS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}",
    "AIza": r"[A-Za-z0-9_-]{35}",
    "ghp_": r"[A-Za-z0-9]{36,}", "gho_": r"[A-Za-z0-9]{36,}", "ghu_": r"[A-Za-z0-9]{36,}",
    "ghs_": r"[A-Za-z0-9]{36,}", "ghr_": r"[A-Za-z0-9]{36,}", "github_pat_": r"[A-Za-z0-9_]{22,}",
    "glpat-": r"[A-Za-z0-9_-]{20,}", "npm_": r"[A-Za-z0-9]{36}",
    "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "xoxa-": r"[A-Za-z0-9-]{10,}",
    "xoxr-": r"[A-Za-z0-9-]{10,}", "xoxs-": r"[A-Za-z0-9-]{10,}",
    "sk_live_": r"[A-Za-z0-9]{16,}", "rk_live_": r"[A-Za-z0-9]{16,}", "sk_test_": r"[A-Za-z0-9]{16,}",
    "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_AFTER = {k: re.compile(v + r"(?![A-Za-z0-9])") for k, v in _KEYS.items()}
_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "api key", "apikey",
          "access_key", "secret_key", "private_key", "client_secret", "credential")

_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
_CUES = ("iban", "account", "acct", "ssn")


def _automaton():
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("0" if c.isdigit() else c, 1))
    for s in _SCHEMES:
        a.add_word(s, ("url", len(s)))
    for c in _CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(c)))
    for c in ("passport", "licence", "license"):
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("paper", len(c)))
    for k in _KEYS:
        a.add_word(k, ("key", len(k)))
    for c in _NAMES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("name", len(c)))
    a.add_word("apiKey", ("name", 6))
    a.add_word("Bearer", ("bearer", 6))
    a.add_word("bearer", ("bearer", 6))
    a.add_word("-----BEGIN ", ("block", 11))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(said: str) -> bool:
    said = said.replace(" ", "")
    return 15 <= len(said) <= 34 and int("".join(str(int(c, 36)) for c in said[4:] + said[:4])) % 97 == 1


def _emails(text: str, at: list[int]) -> list[tuple[int, int]]:
    out, end = [], 0
    for p in at:
        s = p
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((s, end := m.end()))
    return out


def _from_digits(text: str, runs: list[int], pattern: re.Pattern, ok) -> list[tuple[int, int]]:
    """Matches that begin a run of digits.  A match may end inside no run, so
    the next one begins at the next run after it."""
    out, end = [], 0
    for s in runs:
        if s >= end and (m := pattern.match(text, s)):
            end = m.end()
            if ok(m.group()):
                out.append((s, end))
    return out


def _accounts(text: str, cues: list[int]) -> list[tuple[int, int]]:
    out, end = [], 0
    for c in cues:
        s = _GAP.match(text, c).end()
        if s < end:
            continue
        m = _IBAN.match(text, s)
        while m and not iban_ok(m.group()) and m.end() - s > 15:  # a following word may have been taken in
            m = _IBAN.fullmatch(text, s, s + len(text[s:m.end() - 1].rstrip()))
        if m is None or not iban_ok(m.group()):
            m = _NUMBER.match(text, s)
        if m:
            out.append((s, end := m.end()))
    return out


def _papers(text: str, cues: list[int], runs: list[int]) -> list[tuple[int, int]]:
    """Numbers of documents after a cue, and social security numbers."""
    out = []
    for c in cues:
        if (m := _PAPER.match(text, c)) and m.group(1).upper() == m.group(1) and sum(x in "0123456789" for x in m.group(1)) >= 4:
            out.append(m.span(1))
    for s in runs:
        if (m := _SSN.match(text, s)) and text[s - 1:s] != "-":
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                out.append(m.span())
    return out


def _secret(text: str, kind: str, s: int, body: int) -> tuple[tuple[int, int] | None, int]:
    """The secret of one anchor, whose opening or name is text[s:body], or
    None; and the end of what was read for it.  No secret of this kind begins
    before that end, so that anchors within are passed over."""
    if kind == "key":
        if s and (text[s - 1].isalnum() or text[s - 1] in "_-"):
            return None, 0
        m = _AFTER[text[s:body]].match(text, body)
        return (m and (s, m.end())), 0
    if kind == "block":
        head = _BLOCK.match(text, body)
        if head is None:
            return None, 0
        following = text.find("-----BEGIN ", head.end())
        end = _BLOCK_END.search(text, head.end(), following if following >= 0 else len(text)) or _BODY.match(text, head.end())
        return (s, end.end()), end.end()
    m = (_BEARER if kind == "bearer" else _GIVEN).match(text, body)
    if m is None:
        return None, 0
    value = m.group(1)
    if not (any(c in "0123456789" for c in value) and any(c.isalpha() for c in value)):
        return None, m.end()
    return (m.start(1), m.start(1) + len(value.rstrip(".)]}!?:"))), m.end()


def _apart(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans that overlap, the one that starts first, then the longer."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    text = text or ""
    at, plus, digits, urls, cues, papers, secrets = [], [], [], [], [], [], []
    read: dict[str, int] = {}  # for each kind of anchor of a secret, the end of what was read
    for e, (kind, n) in _ANCHORS.iter(text):
        if kind == "0":
            digits.append(e)
        elif kind == "@":
            at.append(e)
        elif kind == "+":
            plus.append(e)
        elif kind == "url":
            urls.append((e - n + 1, e + 1))
        elif kind == "cue":
            cues.append(e + 1)
        elif kind == "paper":
            papers.append(e + 1)
        elif e - n + 1 >= max(read.get(kind, 0), read.get("block", 0)):
            got, upto = _secret(text, kind, e - n + 1, e + 1)
            read[kind] = max(read.get(kind, 0), upto)
            if got:
                secrets.append(got)
    runs = [p for i, p in enumerate(digits) if not i or digits[i - 1] != p - 1]
    out = {
        "email": _emails(text, at),
        "ip": _from_digits(text, runs, _IP, lambda m: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.split("."))),
        "card": _from_digits(text, runs, _CARD, lambda m: 13 <= len(d := m.replace(" ", "").replace("-", "")) <= 19 and luhn(d)),
        "phone": [], "url": [], "account": _apart(_accounts(text, cues) + _papers(text, papers, runs)), "secret": _apart(secrets),
    }
    end = 0
    for p in plus:
        if p >= end and (m := _PHONE.match(text, p)):
            end = m.end()
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append((p, end))
    end = 0
    for s, body in urls:
        i = bisect_left(at, body)
        if s >= end and i < len(at) and (m := _USERINFO.match(text, body)):
            out["url"].append((s, end := m.end()))
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by ``<KIND>``; where spans of several
    kinds overlap, the one that starts first (then the longer) is taken."""
    if not text:
        return text
    spans = sorted((s, -e, kind) for kind, own in find(text).items() for s, e in own)
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
            done = -e
        elif -e > done:  # the rest of an overlapping span goes too
            done = -e
    return "".join([*out, text[done:]])


def joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text column."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, own in find(t).items() for s, e in own] for t in texts])

    return run(text)


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], dtype=object)

    return run(text)


def digest(docs: DataFrame) -> DataFrame:
    """The columns op3 returns: counts and digest of the base kinds, all spans,
    and the counts of the added kinds and of all spans."""
    counted = [f"n_{k}" for k in KINDS[len(BASE):]]
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *counted, "n_spans"]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                  "n_url long, n_account long, n_secret long, n_spans long")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            f = find(t)
            n = [len(f[k]) for k in KINDS]
            rows.append([*n[:len(BASE)], hashlib.sha256(joined(f, BASE).encode()).hexdigest(), joined(f, KINDS), *n[len(BASE):], sum(n)])
        return pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
