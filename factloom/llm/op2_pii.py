"""Personal data and secrets by weak supervision.

The base spans are those of four patterns, and always stay. Further candidates are what looser patterns find: numbers within
longer runs of digits, phone numbers beside other digits or without a country, spelled-out e-mail addresses, long-form ip
addresses, and (a fifth kind) secrets: values that something is set to, and long runs of letters and digits. On every candidate
and every base span five labelers vote yes, no or nothing: a strict pattern, a gazetteer (issuers, area codes, top-level domains,
address families, names of settings), the words around, what touches the span, and its length or variety of characters.
Expectation-maximisation over the votes of all documents estimates how reliable each labeler is for each kind; the posteriors
then train a logistic span classifier on votes and shape, which decides on the candidates.

Votes and shape make a short pattern, and only counts of patterns are gathered: at most 5 * 3**5 * 4 of them, from all rows.

Defined results: a null text counts as empty and holds nothing; an empty document has the digest of an empty list; repeated
rows and null ids are searched each; numbers of any length are read as digits, never as integers; an empty table gives an empty
result; other columns are ignored (redact keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents, tune

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: secrets have no base pattern.
ALL_KINDS = (*KINDS, "secret")
LABELERS = 5
#: Posterior from which a candidate is taken.
LEAST = 0.8
#: Code points on either side in which context words count.
AROUND = 40

_DIGITS = re.compile(r"[0-9][\x20().0-9-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?([A-Za-z0-9-]{1,63})((?:\s?(?:[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]|\.)\s?[A-Za-z0-9-]{2,63}){1,4})")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
_CALL = re.compile(r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SET = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,40})[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}([\"']?)([A-Za-z0-9+/_=.~-]{12,512})(?![A-Za-z0-9+/_=.~-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9+/_=-])")
_HINT = re.compile(r"[0-9a-f]{32}|[0-9A-F]{32}|AKIA|ASIA|gh[opsu]_|sk-|xox|eyJ")
_NAMED = re.compile(r"AKIA|ASIA|gh[opsu]_|sk-|xox[abp]-|eyJ")

#: Fixed values of the gazetteers.
SETTINGS = {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "secret_key", "private_key", "auth", "bearer", "authorization", "credential", "credentials", "client_secret", "access_token", "session"}
PLAIN_SETTINGS = {"id", "name", "class", "href", "src", "style", "type", "value", "lang", "content", "rel", "title", "alt", "http", "https", "url", "width", "height", "version", "commit", "sha", "sha256", "md5", "digest", "checksum"}
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "us", "ch", "at", "it", "nl"}
WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mails?|mail|contact|write|address|correo|courriel|schreib\w*)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv6|host|server|address|adresse|dirección)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|kreditkarte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|call|tel|fax|mobile|cell|téléphone|teléfono|telefon|anruf\w*)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|passw|api.?key|credential|bearer|auth|private key|contraseña|mot de passe|kennwort)"),
}


def _passes(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, the digits' sum a multiple of ten."""
    values = np.frombuffer(digits[::-1].encode(), np.uint8).astype(int) - 48
    values[1::2] *= 2
    return int((values // 10 + values % 10).sum()) % 10 == 0


def _byte(part: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _plain(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns by kind, leftmost and without overlap; matches that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found["email"].append((begin, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for run in _DIGITS.finditer(text):
        cluster, offset = run[0], run.start()
        if len(cluster) < 7:
            continue
        if "." in cluster:
            found["ip"] += [(offset + m.start(), offset + m.end()) for m in _IP.finditer(cluster) if all(_byte(p) for p in m[0].split("."))]
        if len(cluster) >= 13:
            found["card"] += [(offset + m.start(), offset + m.end()) for m in _CARD.finditer(cluster) if m.end() - m.start() >= 13 and 13 <= len(d := _plain(m[0])) <= 19 and _passes(d)]
        if offset and text[offset - 1] == "+" and (m := _PHONE.match(cluster)) and 9 <= len(_plain(m[0])) <= 15:
            found["phone"].append((offset - 1, offset + m.end()))
    return found


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in ALL_KINDS for a, b in sorted(found.get(k, ())))


# --- labelers: each votes 1 (yes), -1 (no) or 0 (nothing) on a span ---------------------------------------------------


def _issuer(digits: str) -> int:
    known = digits[0] in "45" and len(digits) == 16 or digits[:2] in ("34", "37") and len(digits) == 15 or digits[:4] == "6011" or digits[:2] in ("36", "38") and len(digits) == 14
    return 1 if known else -1 if digits[0] in "0789" else 0


def _strict(kind: str, value: str, text: str, a: int) -> int:
    """The pattern labeler: the exact form of its kind."""
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", value) else -1 if value[0] in ".-%" or ".." in value else 0
    if kind == "ip":
        return 1 if ":" in value or all(p == "0" or p[0] != "0" for p in value.split(".")) else -1
    if kind == "card":
        return 1 if _passes(_plain(value)) else -1
    if kind == "phone":
        return 1 if value[0] == "+" or "(" in value else 0 if re.search(r"[\x20.-]", value) else -1
    return 1 if _NAMED.match(value) or a and text[a - 1] in "\"'" else 0


def _known(kind: str, value: str, setting: str) -> int:
    """The gazetteer labeler."""
    digits = _plain(value)
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", value.rstrip(")]}> "))[-1].lower() in DOMAINS else -1 if value[-1].isdigit() else 0
    if kind == "ip":
        if ":" in value:
            return 1 if value[:2].lower() in ("20", "26", "2a", "fe", "fc", "fd") else 0
        first = value.split(".")[0].lstrip("0")
        return -1 if first in ("", "255") else 1 if first in ("10", "127", "172", "192") else 0
    if kind == "card":
        return _issuer(digits)
    if kind == "phone":
        area = digits[-10:]
        return -1 if len(set(digits)) < 3 else 1 if len(area) == 10 and area[0] in "23456789" and area[3] in "23456789" else 0
    return 1 if setting in SETTINGS or any(w in SETTINGS for w in re.split(r"[_.-]", setting)) else -1 if setting in PLAIN_SETTINGS else 0


def _touch(text: str, a: int, b: int) -> int:
    """The border labeler: letters or digits that touch a span speak against it, white space on both sides speaks for it."""
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    return -1 if before.isalnum() or after.isalnum() else 1 if before.isspace() and (after.isspace() or after in ".,;:!?") else 0


def _measure(kind: str, value: str) -> int:
    """The length labeler."""
    digits = _plain(value)
    if kind == "email":
        return 1 if 6 <= len(value) <= 64 else -1
    if kind == "ip":
        return 1 if len(value) >= 7 else -1
    if kind == "card":
        return 1 if len(digits) in (14, 15, 16) else -1
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 13 else -1 if len(digits) > 15 else 0
    kinds = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
    return -1 if kinds < 2 or len(set(value)) < 8 else 1 if len(value) >= 20 else 0


def pattern(kind: str, text: str, a: int, b: int, base: bool, setting: str = "") -> str:
    """kind, votes and shape of a span. shape: whether it is a base span, and whether it has more than digits and letters."""
    value = text[a:b]
    near = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]
    votes = (_strict(kind, value, text, a), _known(kind, value, setting), 1 if WORDS[kind].search(near) else 0, _touch(text, a, b), _measure(kind, value))
    return "|".join(map(str, (kind, *votes, 2 * base + (not value.isalnum()))))


class _Union:
    """Spans as disjoint ones in order, so that a span is held against all of them by bisection."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.starts, a)
        return at > 0 and self.ends[at - 1] > a or at < len(self.starts) and self.starts[at] < b


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of what may be more, apart from the base spans and each other. Secrets may hold base spans."""
    held = _Union(s for spans in base.values() for s in spans)
    raw: list[tuple[str, int, int, str]] = []
    for m in _SPELLED.finditer(text) if "at" in text or "AT" in text or "@" in text else ():
        raw.append(("email", m.start(), m.end(), ""))
    for m in _LONG_IP.finditer(text) if text.count(":") >= 7 else ():
        raw.append(("ip", m.start(), m.end(), ""))
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < 10:
            continue
        cluster, offset = run[0], run.start()
        raw += [("card", offset + m.start(), offset + m.end(), "") for m in _NUMBER.finditer(cluster)]
        for m in _CALL.finditer(cluster):
            plus = offset + m.start() > 0 and text[offset + m.start() - 1] == "+"
            raw.append(("phone", offset + m.start() - plus, offset + m.end(), ""))
    out: list[tuple[str, int, int, str]] = []
    end = 0  # of the last span added: spans come by their start
    for kind, a, b, setting in sorted(raw, key=lambda r: (r[1], -r[2])):
        if a >= end and not held.meets(a, b):
            out.append((kind, a, b, pattern(kind, text, a, b, False, setting)))
            end = b
    settings = [(m.start(3), m.end(3), m[1].lower()) for m in _SET.finditer(text)] if "=" in text or ":" in text else []
    # Matches of one pattern never overlap each other, so runs are compared with settings alone.
    named = _Union((a, b) for a, b, _ in settings)
    runs = ((m.start(), m.end(), "") for m in (_RUN.finditer(text) if _HINT.search(text) else ()))
    out += [("secret", a, b, pattern("secret", text, a, b, False, setting)) for a, b, setting in [*settings, *(r for r in runs if not named.meets(*r[:2]))]]
    return out


def votes(docs: DataFrame) -> dict[str, int]:
    """How often each pattern occurs among all spans of all documents."""

    def run(frames):
        count: Counter = Counter()
        for frame in frames:
            for text in frame.text:
                base = base_spans(text)
                count.update(pattern(k, text, a, b, True) for k in KINDS for a, b in base[k])
                count.update(p for *_, p in candidates(text, base))
        yield pd.DataFrame({"pattern": list(count), "n": list(count.values())}, columns=["pattern", "n"]).astype({"pattern": object, "n": "int64"})

    tune(docs.sparkSession)
    found = documents(docs).select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in found.collect()}  # bounded: see above


def reliabilities(seen: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over rows of votes (-1, 0, 1) that occur n times: posteriors of the rows, and P(vote | truth) as [labeler, truth, vote]."""
    said = seen.astype(int) + 1
    posterior = 1 / (1 + np.exp(-(1.5 * seen[:, 0] + seen[:, 1:].sum(axis=1))))
    table = np.zeros((seen.shape[1], 2, 3))
    for _ in range(rounds):
        share = np.clip((n * posterior).sum() / n.sum(), 1e-4, 1 - 1e-4)
        logs = np.tile(np.log([1 - share, share]), (len(n), 1))
        for j in range(seen.shape[1]):
            for truth, weight in enumerate((n * (1 - posterior), n * posterior)):
                table[j, truth] = np.bincount(said[:, j], weight, 3) + 0.5
                table[j, truth] /= table[j, truth].sum()
                logs[:, truth] += np.log(table[j, truth][said[:, j]])
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return posterior, table


def _features(parts: list[list[str]]) -> np.ndarray:
    """Votes as indicators, shape as indicators, and one."""
    rows = np.array([[int(x) for x in p[1:]] for p in parts]).reshape(len(parts), LABELERS + 1)
    return np.concatenate([(rows[:, j, None] == np.arange(-1, 2)) for j in range(LABELERS)] + [rows[:, LABELERS, None] % 2 == np.arange(2), np.ones((len(parts), 1))], axis=1).astype(float)


def classifier(count: dict[str, int], least: float = LEAST) -> dict[str, float]:
    """The final span classifier's probability of every pattern that reaches `least`."""
    taken: dict[str, float] = {}
    for kind in ALL_KINDS:
        patterns = sorted(p for p in count if p.split("|")[0] == kind)
        if not patterns:
            continue
        split = [p.split("|") for p in patterns]
        n = np.array([count[p] for p in patterns], float)
        posterior, _ = reliabilities(np.array([[int(x) for x in p[1 : 1 + LABELERS]] for p in split]), n)
        x = _features(split)
        beta = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's steps on the weighted soft labels
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta += np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(x.shape[1]), x.T @ (n * (posterior - p)) - 0.1 * beta)
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        taken |= {pattern: float(q) for pattern, q in zip(patterns, p, strict=True) if q >= least}
    return taken


def spans(text: str, taken: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    every = {k: list(base.get(k, ())) for k in ALL_KINDS}
    for kind, a, b, pattern in candidates(text, base):
        if pattern in taken:
            every[kind].append((a, b))
    return base, every


def fit(docs: DataFrame) -> dict[str, float]:
    """The patterns that the final classifier takes, learned from all of docs."""
    return classifier(votes(docs))


def found(taken: dict[str, float]) -> Column:
    """A column over text: struct of base counts, digest of the base spans, all spans, and how many the method added."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.fillna(""):
                base, every = spans(text, taken)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), (total := sum(map(len, every.values()))) - sum(map(len, base.values())), len(every["secret"]), total))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    return run(F.col("text").cast("string"))


def redacted(text: str, taken: dict[str, float]) -> str:
    """The text with a mark of its kind in place of each span; of spans that overlap, the earlier and longer one counts."""
    _, every = spans(text, taken)
    out, done = [], 0
    for a, b, kind in sorted(((a, b, k) for k in ALL_KINDS for a, b in every[k]), key=lambda s: (s[0], -s[1])):
        if b > done:
            out += [text[done : max(a, done)], f"[{kind.upper()}]" if a >= done else ""]
            done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by a mark; null texts stay null."""
    tune(docs.sparkSession)
    taken = fit(docs)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: redacted(t, taken) if isinstance(t, str) else None).astype(object)

    return docs.withColumn("text", run(F.col("text").cast("string")))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of `found`."""
    rows = documents(docs)
    return rows.select("doc_id", found(fit(docs)).alias("found")).select("doc_id", "found.*")
