"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans (they always stay), wider patterns further
candidates.  Labelers - the strict format, gazetteers, the words before and
after - each vote yes, no or nothing on every candidate.  The votes of the
whole corpus are counted by pattern of votes (a bounded table);
expectation-maximisation over those counts estimates each labeler's
reliability, and a logistic span classifier is trained on the resulting
probabilities.  It decides which wider candidates become spans.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.llm.common import stored

# Kinds in order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "masked_email", "number", "name")
BASE = 4
# The base patterns.  Lookbehind and possessive runs only spare
# the search inside a run that has failed; the matches are those of
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([ -]?[0-9])+   with 14 digits or more
#   \+[0-9][ ().0-9-]+[0-9]
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9]){13,}+",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z+.-])\(?[0-9]{3,5}\)?[ -][0-9]{2,4}[ -][0-9]{3,4}(?![0-9A-Za-z-])",
    r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-ZÀ-Þ][a-zß-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,20})?",
)
# What a text must hold for a pattern to be searched at all.
NEEDS = ("@", "[0-9]", "[0-9]", r"\+[0-9]", r"[\[(]at[\])]", "[0-9]", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ")
# Gazetteers and context words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
TITLES = ("Mrs", "Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme")
AREA_WORDS = ("tel", "phone", "mobile", "fax", "call", "ssn", "passport", "account", "iban", "telefon", "teléfono", "téléphone")
CUES = r"(?i)(?:e-?mail|contact|kontakt|contacto|phone|tel|mobile|fax|call|write to|reach|address|ip|card|visa|account|ssn|passport|name|signed|dear)\W{0,6}\w*\W{0,3}$"
COUNTERS = r"(?i)(?:version|page|pages|isbn|issn|figure|table|section|chapter|\$|€|http\S*|www\S*)\W{0,4}$"
UNITS = r"(?i)^\s?(?:%|€|\$|km|kg|mb|gb|ms|px|years?|people)"
AROUND = 40
LABELERS = 5
THRESHOLD = 0.8
_SPAN = "struct<start:int,kind:int,end:int,match:string>"


def _searched(text: Column, kind: int) -> tuple[Column, Column]:
    """(matches, lengths of what stands between them), both null if none."""
    has = text.rlike(NEEDS[kind])
    return (F.when(has, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))),
            F.when(has, F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.char_length(p))))


def _placed(found: str, gaps: str, kind: int) -> Column:
    """Spans of one kind from its matches and the lengths between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        match = F.get(F.col(found), i)
        begin = acc["at"] + F.get(F.col(gaps), i)
        end = begin + F.char_length(match)
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1))
    placed = F.aggregate(F.coalesce(every, F.array().cast("array<int>")), start, step)["spans"]
    return F.filter(placed, lambda s: _fits(s["match"], kind))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _fits(match: Column, kind: int) -> Column:
    """The conditions on a base match; failing matches are dropped."""
    if kind == 1:
        part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(match))
    if kind == 2:
        return F.when(n.between(14, 19), _luhn(match)).otherwise(F.lit(False))
    if kind == 3:
        return n.between(10, 15)
    return F.lit(True)


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")
    total = F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
                    .otherwise(d.cast("int"))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _votes(span: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 yes, 0 no, -1 nothing."""
    text, kind, match = F.col("text"), span["kind"], span["match"]
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - AROUND + 1), F.least(F.lit(AROUND), span["start"]))
    after = F.substring(text, span["end"] + 1, F.lit(AROUND))
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    digits = _digits(match)
    strict = F.when(kind < BASE, 1).when(kind == KINDS.index("number"), F.when(match.rlike(r"^(?:19|20)[0-9]{2}[ -]"), 0).otherwise(-1)).otherwise(-1)
    gazetteer = (F.when(kind.isin(0, 4), domain.isin(*TOP_DOMAINS).cast("int"))
                 .when(kind == 6, match.rlike(rf"^(?:{'|'.join(TITLES)})\b").cast("int"))
                 .when(kind == 5, F.when(F.lower(before).rlike(rf"(?:{'|'.join(AREA_WORDS)})\W*\w*\W*$"), 1).otherwise(-1))
                 .otherwise(-1))
    context = F.when(before.rlike(CUES), 1).when(before.rlike(COUNTERS), 0).otherwise(-1)
    follows = F.when(after.rlike(UNITS), 0).otherwise(-1)
    shape = (F.when(digits == "", -1).when(digits.rlike(r"^([0-9])\1*$"), 0)
             .when(kind.isin(2, 3), 1).when(kind == 5, F.when(F.length(digits).between(9, 12), -1).otherwise(0)).otherwise(-1))
    return [v.cast("int") for v in (strict, gazetteer, context, follows, shape)]


def em(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Dawid-Skene for binary votes over counted vote patterns: (share of yes,
    per labeler (P(1 | yes), P(1 | no)) among its votes, P(yes | pattern))."""
    rel = [(0.8, 0.2)] * LABELERS
    share, post = 0.5, {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = math.log(share), math.log(1 - share)
            for v, (a, b) in zip(votes, rel, strict=True):
                if v >= 0:
                    yes += math.log(a if v else 1 - a)
                    no += math.log(b if v else 1 - b)
            post[votes] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
        total = sum(counts.values())
        if not total:
            break
        share = min(0.99, max(0.01, sum(n * post[v] for v, n in counts.items()) / total))
        new = []
        for k in range(LABELERS):
            # pseudo-votes hold a labeler to being better than chance
            cell = [[8.0, 2.0], [2.0, 8.0]]   # [truth no / yes][vote no / yes]
            for v, n in counts.items():
                if v[k] >= 0:
                    cell[1][v[k]] += n * post[v]
                    cell[0][v[k]] += n * (1 - post[v])
            new.append((cell[1][1] / sum(cell[1]), cell[0][1] / sum(cell[0])))
        rel = new
    return share, rel, post


def fit_classifier(rows: Sequence[tuple[int, tuple[int, ...], int, float]], steps: int = 300) -> list[float]:
    """Logistic regression on (kind, votes, count, probability) rows: one
    weight per kind, then two per labeler (voted yes, voted no)."""
    size = len(KINDS) + 2 * LABELERS
    w, g2 = [0.0] * size, [1e-8] * size
    total = sum(r[2] for r in rows) or 1
    data = [(_active(kind, votes), n / total, p) for kind, votes, n, p in rows]
    for _ in range(steps):
        grad = [1e-4 * x for x in w]
        for active, n, p in data:
            err = (1 / (1 + math.exp(-max(-35, min(35, sum(w[i] for i in active))))) - p) * n
            for i in active:
                grad[i] += err
        for i, g in enumerate(grad):
            g2[i] += g * g
            w[i] -= 0.5 * g / math.sqrt(g2[i])
    return w


def _active(kind: int, votes: Sequence[int]) -> list[int]:
    return [kind] + [len(KINDS) + 2 * k + (1 - v) for k, v in enumerate(votes) if v >= 0]


def _probability(span: Column, w: Sequence[float]) -> Column:
    z = F.get(F.array(*map(F.lit, w[:len(KINDS)])), span["kind"])
    for k in range(LABELERS):
        v = F.get(span["votes"], F.lit(k))
        z = z + F.when(v == 1, w[len(KINDS) + 2 * k]).when(v == 0, w[len(KINDS) + 2 * k + 1]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` per row: all candidates with start, kind, end (code
    points, end exclusive) and votes, by start, then kind.  Wider candidates
    that overlap a base span are none."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = {k: _searched(F.col("text"), k) for k in range(len(KINDS))}
    found = texts.select("doc_id", "text", *(c.alias(f"{name}{k}") for k, pair in every.items()
                                             for name, c in zip(("found", "gaps"), pair, strict=True)))
    spans = found.select("doc_id", "text", F.concat(*(_placed(f"found{k}", f"gaps{k}", k) for k in every)).alias("spans"))
    spans = spans.withColumn("base", F.filter("spans", lambda s: s["kind"] < BASE)).withColumn("spans", F.filter(
        "spans", lambda s: (s["kind"] < BASE) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return spans.select("doc_id", F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.array(*_votes(s)).alias("votes")))).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, spans)``: for every row its spans as ``array<struct<start,
    kind, end, votes, probability>>`` - all base spans and the wider candidates
    the classifier takes, by start, then kind.

    Rows are judged one by one: null texts are empty and have no spans, null
    ids and repeated rows need no care, an empty table gives no rows, other
    columns are ignored.
    """
    found = stored(candidates(docs, id_col, text_col), "pii-candidates")
    seen = (found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect())
    counts: dict[tuple[int, ...], int] = {}
    for r in seen:   # at most kinds * 3^labelers rows
        counts[tuple(r.votes)] = counts.get(tuple(r.votes), 0) + r.n
    _, _, post = em(counts)
    w = fit_classifier(sorted((r.kind, tuple(r.votes), r.n, post[tuple(r.votes)]) for r in seen))
    scored = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                     s["votes"].alias("votes"), _probability(s, w).alias("probability")))
    return found.select("doc_id", F.filter(scored, lambda s: (s["kind"] < BASE) | (s["probability"] >= threshold)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find`` gives."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
