"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns over the whole text. The field then labels other mentions of
the same thing in the same document. Its nodes are the base spans, whose labels are held, and the
candidates: number phrases of seven digits or more, and words that hold the local part of an
address found. Neighbouring nodes are joined by a chain; nodes with the same or similar content, at
any distance, are joined by skip edges from each occurrence to the one before it and to the
first, so that edges grow with the nodes. Loopy sum-product messages run for a fixed number of
rounds; a candidate whose likeliest label isn't ``O`` becomes a span. In a document without a base
span no label has support, and none is added.

Node and edge potentials are smoothed log ratios of counts from a bounded sample of documents
(``sample_docs``), a table of fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotable.llm.storage import bounded_batches
from echotable.llm.tables import free_names

KINDS = ("email", "ip", "card", "phone")
_O = len(KINDS)
_LABELS = len(KINDS) + 1
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ is looked at once: its local part is the run before it, its domain what follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; ends are exclusive, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # ASCII classes throughout: [0-9], never \\d.
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def _shape(content: str) -> int:
    """One of 128 shapes: digits, separators, a leading plus, an at sign."""
    digits = min(len(_NOT_DIGIT.sub("", content)), 15)
    return digits * 8 + 4 * ("@" in content) + 2 * content.startswith("+") + any(c in " ().-" for c in content)


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """``(start, end, label or -1, key)`` in order; candidates don't overlap base spans."""
    out = []
    for k, a, b in base:
        out.append((a, b, k, text[a:b].split("@")[0].lower() if k == 0 else _NOT_DIGIT.sub("", text[a:b])))
    covered = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in covered]
    reach = list(np.maximum.accumulate([b for _, b in covered])) if covered else []

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b)) - 1
        return i < 0 or reach[i] <= a

    for m in _NUMBER.finditer(text) if any(k for k, _, _ in base) else ():
        if free(*m.span()):
            out.append((*m.span(), -1, _NOT_DIGIT.sub("", m[0])))
    locals_ = {key for _, _, k, key in out if k == 0 and len(key) >= 4 and not key.isalpha()}
    if locals_:
        for m in re.finditer(r"[A-Za-z0-9._%+-]+", text):
            word = m[0].lower().strip("._%+-")
            if word in locals_ and free(*m.span()):
                a = m.start() + m[0].lower().index(word)
                out.append((a, a + len(word), -1, word))
    out.sort()
    return out


def _skip_edges(found: list) -> list[tuple[int, int, float]]:
    """Edges of equal keys (weight 1) and of equal last seven digits (weight 0.8)."""
    edges = {}
    for weight, cut in ((0.8, 7), (1.0, None)):
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for i, (_, _, _, key) in enumerate(found):
            if cut:
                if not key.isdigit() or not 7 <= len(key) <= 15:
                    continue
                key = key[-cut:]
            for j in {first.get(key), last.get(key)} - {None}:
                edges[j, i] = weight
            first.setdefault(key, i)
            last[key] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def default_potentials() -> tuple[np.ndarray, float]:
    return np.zeros((128, _LABELS)), 3.0


def add_spans(text: str, base: list, potentials: tuple[np.ndarray, float], rounds: int = 10) -> list[tuple[int, int, int]]:
    """Spans that the field adds to ``base``."""
    found = nodes(text, base) if base else []
    if all(label >= 0 for _, _, label, _ in found):
        return []
    unary_table, agree = potentials
    skips = _skip_edges(found)
    pairs = [(i, i + 1, 0.05) for i in range(len(found) - 1)] + skips
    src = np.array([i for i, j, _ in pairs] + [j for i, j, _ in pairs])
    dst = np.array([j for i, j, _ in pairs] + [i for i, j, _ in pairs])
    weight = np.array([w for *_, w in pairs] * 2) * agree
    m = len(pairs)
    unary = np.empty((len(found), _LABELS))
    for i, (a, b, label, _) in enumerate(found):
        if label >= 0:
            unary[i] = -20.0
            unary[i, label] = 0.0
        else:
            unary[i] = unary_table[_shape(text[a:b])]
            unary[i, _O] += 1.5
    message = np.zeros((2 * m, _LABELS))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    gain = np.expm1(weight)[:, None]
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        cavity = belief[src] - message[back]
        cavity -= cavity.max(1, keepdims=True)
        p = np.exp(cavity)
        fresh = np.log(p.sum(1, keepdims=True) + gain * p)  # sum over labels; equal labels weigh exp(weight)
        fresh -= fresh.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * fresh
    belief = unary.copy()
    np.add.at(belief, dst, message)
    best = belief.argmax(1)
    return [(int(k), a, b) for k, (a, b, label, _) in zip(best, found) if label < 0 and k != _O]


def _counts(pdfs):
    table, same, other = np.zeros((128, _LABELS)), 0, 0
    for pdf in pdfs:
        for text in pdf.text:
            found = nodes(text, base_spans(text))
            known = {key for _, _, label, key in found if label >= 0}
            for a, b, label, key in found:
                if label >= 0:
                    table[_shape(text[a:b]), label] += 1
                elif key not in known:
                    table[_shape(text[a:b]), _O] += 1
            for i, j, w in _skip_edges(found):
                if w == 1 and found[i][2] >= 0 and found[j][2] >= 0:
                    same, other = same + (found[i][2] == found[j][2]), other + (found[i][2] != found[j][2])
    yield pd.DataFrame({"cell": np.append(np.arange(table.size), [-1, -2]), "n": np.append(table.ravel(), [same, other]).astype(int)})


def fit(docs: DataFrame, text_col: str = "text", key: str = "doc_id", sample_docs: int = 20_000) -> tuple[np.ndarray, float]:
    """Potentials from about ``sample_docs`` documents that hold an @ or a digit, chosen by a hash of ``key``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("k")).where("text is not null")
    total = docs.count()
    if total > sample_docs:
        rows = rows.where(F.col("k") < int((1 << 30) * sample_docs / total))
    rows = rows.where(F.col("text").rlike("[0-9@]")).select("text")
    sums = rows.mapInPandas(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 642 cells
    table, agree = np.zeros(128 * _LABELS), {-1: 0, -2: 0}
    for r in sums:
        if r.cell < 0:
            agree[r.cell] = r.n
        else:
            table[r.cell] = r.n
    table = table.reshape(128, _LABELS)
    smooth = table + 2.0
    unary = np.log(smooth / smooth.sum(1, keepdims=True)) + np.log(_LABELS)
    unary = np.clip(unary, -4.0, 0.5)  # a shape alone proves neither O nor a kind
    return unary, float(np.clip(np.log((agree[-1] + 20) / (agree[-2] + 1)), 2.0, 4.0))


def find(docs: DataFrame, potentials: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_added``: arrays of (kind, start, end); columns of those names are replaced.

    A null or empty text has empty ones. Each row is judged by itself, so repeated rows get equal spans; an
    empty table gives none. Words that are letters alone, or shorter than four, are no candidates of
    the field even where they equal an address's local part: names are common words too often.
    """
    bounded_batches(docs.sparkSession)
    span = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))

    @F.pandas_udf(T.StructType().add("base", span).add("added", span))
    def spans(texts: pd.Series) -> pd.DataFrame:
        base = [base_spans(t or "") for t in texts]
        more = [add_spans(t or "", b, potentials) if b else [] for t, b in zip(texts, base)]
        rows = lambda s: [{"kind": KINDS[k], "start": a, "end": e} for k, a, e in sorted(s)]
        return pd.DataFrame({"base": [rows(b) for b in base], "added": [rows(m) for m in more]})

    (name,) = free_names(docs, "spans")
    found = docs.withColumn(name, spans(F.col(text_col)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("pii_base", "pii_added")]
    return found.select(*kept, F.col(f"{name}.base").alias("pii_base"), F.col(f"{name}.added").alias("pii_added"))


def mask(docs: DataFrame, potentials: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets.

    Overlapping spans are replaced together, by the kind of the first. A null text stays null.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base = base_spans(t or "")
            if not base:
                out.append(t)
                continue
            parts, at = [], 0
            for a, b, k in sorted((a, b, k) for k, a, b in base + add_spans(t, base, potentials)):
                if a >= at:
                    parts += [t[at:a], f"<{KINDS[k].upper()}>"]
                at = max(at, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def digest(docs: DataFrame, potentials: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base spans by kind, the base digest, all spans joined."""
    found = find(docs.select(F.col(id_col), F.col(text_col)), potentials, text_col)
    kind_at = lambda s: F.array_position(F.lit(list(KINDS)), s.kind)
    ordered = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(kind_at(s).alias("at"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    text = lambda c: F.array_join(F.transform(ordered(c), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col(id_col), *[count(k) for k in KINDS], F.sha2(text(F.col("pii_base")), 256).alias("base_sha256"),
        text(F.concat("pii_base", "pii_added")).alias("spans"), F.size("pii_added").cast("long").alias("n_added"),
    )
