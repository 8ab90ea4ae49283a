"""Personal data: candidates, boosted trees, calibrated thresholds.

Base spans are what the four rules (e-mail, IP address, card number, phone number) find; they always stay. High-recall
generators propose further, overlapping spans: numbers grouped like phone or card numbers without the signs that the
rules ask for, addresses with their signs spelled out, and numbers of four parts with other dots. Boosted trees judge
each candidate by its format and by the words before and after it; what reaches its kind's threshold and overlaps no
base span or better candidate is a span too.

The trees are fitted on the driver, on examples that ``examples`` writes from a seed: personal data in several formats
in telling and in plain surroundings, and look-alikes (order numbers, versions, dates, sums, measures, code). Each
threshold is the least at which examples set aside are kept with the wanted precision.

Null texts count as empty and have no spans. Repeated texts have equal spans. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import map_batches, texts

KINDS = ("email", "ip", "card", "phone")

#: (kind, start, end)
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number is tried from its first digit only: from inside it no other match could come
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]++")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """From every @: the longest local part to its left that no earlier match took, and the domain to its right. This is
    what a scan from the left finds, in linear time."""
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = taken = m.end()
            yield "email", start, end
        else:
            taken = max(taken, start)
        at = text.find("@", end)


def phones(text: str) -> Iterator[Span]:
    """Every run of phone characters after a plus and a digit, up to its last digit."""
    at = text.find("+")
    while at >= 0:
        end = at + 1
        if m := _PHONE_RUN.match(text, at):
            stop = m.end()
            while stop > at + 3 and not "0" <= text[stop - 1] <= "9":
                stop -= 1
            if stop > at + 3:
                end = stop
                if 9 <= len(_only_digits(text[at:stop])) <= 15:
                    yield "phone", at, stop
        at = text.find("+", end)


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by kind and place."""
    out = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _only_digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += phones(text)
    return out


# ---- candidates ----------------------------------------------------------------------------------------------------

#: High-recall patterns of each kind. They may overlap each other and the base spans.
GENERATORS: dict[str, re.Pattern[str]] = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}(?:[ ]?[(\[{<]at[)\]}>][ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[(\[{<]dot[)\]}>][ ]?| dot )[A-Za-z0-9-]{1,63}){1,4}"
        r"| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4})",
        re.I,
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]| dot )[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]| dot |\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]| dot |\.)[0-9]{1,3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}[./_\xa0\t][0-9]{4}[./_\xa0\t][0-9]{4}[./_\xa0\t][0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:00[0-9]{2}[ ./-]?|\(?0?[0-9]{2,4}\)?[ ./-])[0-9]{2,4}[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){0,2}(?![0-9A-Za-z])"),
}
#: A text without any of these has no candidates.
_HINT = re.compile(r"[0-9]{2}|[0-9](?:\[\.\]|\(\.\)|\[dot\]| dot )|[(\[{<]at[)\]}>]| at ", re.I)
_AT = re.compile(r"[(\[{<]at[)\]}>]|(?<= )at(?= )", re.I)
#: Characters of context to each side.
CONTEXT = 40

#: Words that tell what a number or address is, and words that tell that it is something else.
TELLING = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "kontakt", "adresse"),
    "ip": ("ip", "host", "server", "address", "client", "login", "addr", "ping", "dirección", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "tarjeta", "carte", "karte", "kreditkarte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "sms", "teléfono", "téléphone", "telefon", "anruf", "llame", "appelez"),
}
OTHERWISE = ("order", "invoice", "version", "isbn", "issn", "ref", "no.", "nr.", "page", "pages", "date", "year", "section", "id", "part", "serial", "score", "total", "sum", "eur", "usd", "$", "€", "kg", "km", "lot", "batch", "ticket")
_WORD = re.compile(r"[^\s:;,()]+")


def proposals(text: str) -> list[Span]:
    """Candidate spans of all kinds, by kind and place."""
    if not _HINT.search(text):
        return []
    out: list[Span] = []
    last = -1
    for m in _AT.finditer(text):  # only around its sign; the pattern alone would try every word
        begin = max(0, m.start() - 66, last)
        if found := GENERATORS["email"].search(text, begin, min(len(text), m.end() + 330)):
            if found.start() <= m.start() < found.end():
                out.append(("email", *found.span()))
                last = found.end()
    if _DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            out += [(kind, *m.span()) for m in GENERATORS[kind].finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Numbers about the format of the span and about its surroundings."""
    kind, start, end = span
    own = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = _WORD.findall(before)[-5:] + _WORD.findall(after)[:3]
    digits = _only_digits(own)
    groups = re.findall(r"[0-9]+", own)
    marks = [c for c in own if not c.isalnum()]
    last = own.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
    return [
        float(KINDS.index(kind)),
        len(own),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(set(marks)),
        float("(" in own and ")" in own),
        own.count("."),
        own.count("-") + own.count(" "),
        own.count("/"),
        float(luhn(digits)) if digits else 0.0,
        float(own[:1] == "0" or own[:1] == "("),
        float(bool(groups) and all(int(g) <= 255 for g in groups)),
        float(bool(re.search(r"[\[({<](?:at|dot|\.)[\])}>]", own, re.I))),
        float(len(last) if last.isalpha() else 0),
        float(any(w.strip(".:#") in TELLING[kind] for w in near)),
        float(any(w in OTHERWISE or w.strip(".:#") in OTHERWISE for w in near)),
        float(before[-1:].isalnum() or after[:1].isalnum()),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}", own))),
    ]


# ---- boosted trees -------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A regression tree in arrays: leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def of(self, row: list[float]) -> float:
        i = 0
        while self.feature[i] >= 0:
            i = self.left[i] if row[self.feature[i]] <= self.cut[i] else self.right[i]
        return self.value[i]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0) -> Tree:
    """Second-order gain splits over all cuts between distinct values."""
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        i = len(tree.feature)
        G, H = g[rows].sum(), h[rows].sum()
        for column, v in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(-G / (H + ridge)))):
            column.append(v)
        best = (1e-6, -1, 0.0)
        if level < depth:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values = x[order, f]
                gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                ok = (values[1:] > values[:-1]) & (hl >= least / 4) & (H - hl >= least / 4)
                if ok.any():
                    gain = np.where(ok, gl * gl / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G * G / (H + ridge), 0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, float((values[at] + values[at + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[i], tree.cut[i] = best[1], best[2]
            tree.left[i] = node(rows[low], level + 1)
            tree.right[i] = node(rows[~low], level + 1)
        return i

    node(np.arange(len(x)), 0)
    return tree


@dataclass
class Model:
    """Boosted trees for the log-odds that a candidate is personal data, and each kind's threshold."""

    prior: float
    rate: float
    trees: list[Tree]
    thresholds: dict[str, float]

    def probability(self, row: list[float]) -> float:
        z = self.prior + self.rate * sum(t.of(row) for t in self.trees)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25) -> Model:
    """Newton boosting of the logistic loss."""
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_grow(x, p - y, p * (1 - p), depth))
        z += rate * np.array([trees[-1].of(row) for row in x.tolist()])
    return Model(prior, rate, trees, dict.fromkeys(KINDS, 0.5))


def examples(count: int = 3000, seed: int = 3) -> list[tuple[str, Span, int]]:
    """(text, span, whether it is personal data): spans of every generator in written surroundings."""
    rng = np.random.default_rng(seed)
    pick = lambda *of: of[int(rng.integers(len(of)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(*"abcdefghilmnoprstu") for _ in range(int(rng.integers(2, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    year = lambda: pick("19", "20") + number(2)

    def card(sep: str) -> str:
        digits = pick("4", "5", "37", "6011") + number(15)
        digits = digits[:15]
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    real: dict[str, Callable[[], str]] = {
        "email": lambda: pick(lambda: f"{word()}{pick('', '.', '_')}{word()} (at) {word()} (dot) {pick('com', 'org', 'net', 'de', 'fr')}", lambda: f"{word()}.{word()}[at]{word()}.{pick('com', 'org', 'io')}", lambda: f"{word()} at {word()} dot {pick('com', 'org', 'net')}")(),
        "ip": lambda: pick("[.]", "(.)", "[dot]").join(str(int(n)) for n in rng.integers(1, 255, 4)),
        "card": lambda: card(pick(".", "/", "_", "\xa0")),
        "phone": lambda: pick(lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"00{number(2)} {number(3)} {number(3)} {number(3)}", lambda: f"0{number(2)} {number(3)} {number(4)}", lambda: f"0{number(3)}/{number(6)}")(),
    }
    fake: dict[str, Callable[[], str]] = {
        "email": lambda: f"{word()} {pick('[at]', '(at)', 'at')} {word()} dot {word()}",
        "ip": lambda: f"{number(1)} dot {number(1)}.{number(1)}.{number(1)}",
        "card": lambda: pick(".", "/", "_").join([number(4), number(4), number(4), number(int(rng.integers(1, 7)))]),
        "phone": lambda: pick(lambda: f"{year()}-{number(2)}-{number(2)}", lambda: f"{number(2)}/{number(2)}/{year()}", lambda: f"{number(2)}.{number(2)}.{year()}", lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"{number(2)}-{number(4)}-{number(2)}", lambda: f"{number(4)} {number(4)}", lambda: f"{number(3)}-{number(4)}-{number(3)}")(),
    }
    out: list[tuple[str, Span, int]] = []
    while len(out) < count:
        kind = pick(*KINDS)
        true = bool(rng.random() < 0.5)
        own = (real if true else fake)[kind]()
        told = rng.random() < (0.7 if true else 0.05)
        other = rng.random() < (0.03 if true else 0.6)
        if true and not told and kind == "phone" and not own.startswith("("):
            true = False  # digits in groups tell nothing by themselves
        lead = f"{pick(*TELLING[kind])}{pick(':', '', '.')} " if told else f"{pick(*OTHERWISE)} " if other else ""
        text = f"{prose(int(rng.integers(1, 6)))} {lead}{own} {prose(int(rng.integers(1, 6)))}"
        found = next((s for s in proposals(text) if s[0] == kind and own[:3] in text[s[1] : s[2]]), None)
        if found:
            out.append((text, found, int(true)))
    return out


def fit(count: int = 3000, precision: float = 0.99, seed: int = 3) -> Model:
    """Fits the trees on three quarters of the examples and the thresholds on the others."""
    made = examples(count, seed)
    x = np.array([features(text, span) for text, span, _ in made])
    y = np.array([label for *_, label in made], float)
    cut = len(made) * 3 // 4
    model = boost(x[:cut], y[:cut])
    for kind in KINDS:
        own = sorted(((model.probability(row), label) for row, label, (_, span, _) in zip(x[cut:].tolist(), y[cut:].tolist(), made[cut:], strict=True) if span[0] == kind), reverse=True)
        hits, best = 0.0, 0.99
        for i, (p, label) in enumerate(own):
            hits += label
            if hits / (i + 1) >= precision and (i + 1 == len(own) or own[i + 1][0] < p):
                best = (p + (own[i + 1][0] if i + 1 < len(own) else p)) / 2
        model.thresholds[kind] = max(0.5, best)
    return model


def all_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Base spans and the candidates that the model selects, by kind and place."""
    found = proposals(text)
    if not found:
        return base
    # what is taken, as stretches that do not overlap, so that the one before a place tells all
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((start, end) for _, start, end in base):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i == 0 or ends[i - 1] <= start

    scored = [(model.probability(features(text, s)), s) for s in found if free(s[1], s[2])]
    more: list[Span] = []
    for p, span in sorted(scored, key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if p >= model.thresholds[span[0]] and free(span[1], span[2]):
            more.append(span)
            at = bisect_left(starts, span[1])
            starts.insert(at, span[1])
            ends.insert(at, span[2])
    return sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


#: A column's name, its type in SQL and in Arrow.
Column = tuple[str, str, pa.DataType]


def find(df: DataFrame, model: Model, derive: Callable[[str, list[Span], list[Span]], tuple], columns: list[Column], text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, *columns) of every row, where ``derive(text, base spans, all spans)`` gives the values of ``columns``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in texts(b.column(1)):
                base = base_spans(x)
                rows.append(derive(x, base, all_spans(x, base, model)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(cols, columns, strict=True))], names=[keep, *(n for n, _, _ in columns)])

    return map_batches(df.select(keep, text), run, f"`{keep}` {dict(df.dtypes)[keep]}, " + ", ".join(f"{n} {t}" for n, t, _ in columns))


def spans(df: DataFrame, model: Model, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, spans array<struct<kind, start, stop, base>>) of every row."""

    def listed(_: str, base: list[Span], every: list[Span]) -> tuple:
        rule = set(base)
        return ([{"kind": s[0], "start": s[1], "stop": s[2], "base": s in rule} for s in every],)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
    return find(df, model, listed, [("spans", "array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>", kind)], text, keep)


def redacted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with spans in their text replaced by their kinds; null texts stay null."""
    columns = df.columns
    names = [f"_c{i}" for i in range(len(columns))]
    kinds = dict(df.dtypes)
    where = columns.index(text)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else redact(x, all_spans(x, base_spans(x), model)) for x in b.column(where).to_pylist()]
            arrays = list(b.columns)
            arrays[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, columns, strict=True))
    return map_batches(df.toDF(*names), run, schema).toDF(*columns)
