"""Personal data by weak supervision.

Patterns find candidate spans in whole texts. Labelers of three kinds vote on
each candidate, for (+1), against (-1) or not at all (0): a pattern's own check
(Luhn, IBAN remainder, lengths), gazetteers (mail providers, calling codes, card
issuers, first names, reserved address ranges) and context (words and signs
around the span). How often each vote pattern occurs is counted in Spark;
expectation-maximisation on these counts estimates each labeler's reliability
by kind. The posteriors train a logistic span classifier on discrete features,
again by their counts; so training sees every candidate, and the driver a table
whose size does not depend on the data (kinds x votes x feature classes).

The base kinds (email, ip, card, phone) are exact: leftmost non-overlapping
matches that pass their check are always reported. The classifier decides on
further kinds: obfuscated addresses, national phone numbers, social security
numbers, bank accounts and names.

Null text is an empty text. Rows with equal ids are searched each. Very long
texts are searched whole, in time that grows with their length (and the logarithm
of their spans). Of overlapping candidates base spans come first, then the earlier
kind of KINDS, then the one that begins first. Votes that tie leave a probability
of THRESHOLD or not; at THRESHOLD a span is kept. Empty table: no rows. Extra
columns are not read, whatever their names. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_spelled", "phone_national", "ssn", "iban", "name")
LABELERS = ("check", "gazetteer", "cue", "counter_cue", "edges")
THRESHOLD, WINDOW, ROUNDS = 0.5, 48, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_AT = re.compile(r"[\[(]at[\])]")
_SPELLED = re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,4}")
_NAME = re.compile(r"(?:[Mm]y name is|Mr\.|Mrs\.|Ms\.|Dr\.|[Ss]igned,|[Cc]ontact:?) ([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?)")

#: Gazetteers: mail providers, the endings of domains, and first names of several languages.
PROVIDERS = frozenset(
    """gmail.com googlemail.com yahoo.com yahoo.co.uk yahoo.fr yahoo.de yahoo.es ymail.com hotmail.com hotmail.co.uk hotmail.fr outlook.com live.com msn.com
    aol.com icloud.com me.com mac.com gmx.de gmx.net gmx.com gmx.at web.de t-online.de freenet.de mail.ru yandex.ru yandex.com rambler.ru proton.me protonmail.com
    zoho.com fastmail.com tutanota.com mail.com orange.fr wanadoo.fr free.fr laposte.net sfr.fr libero.it virgilio.it tin.it alice.it terra.es telefonica.net
    comcast.net verizon.net att.net sbcglobal.net cox.net btinternet.com sky.com qq.com 163.com 126.com sina.com naver.com hanmail.net rediffmail.com uol.com.br bol.com.br""".split()
)
SUFFIXES = frozenset(
    """com org net edu gov mil int info biz name pro io ai app dev co me tv cc xyz online site shop eu de fr es it pt nl be lu ch at uk ie dk se no fi is pl cz sk hu ro bg gr
    hr si rs ru ua by lt lv ee tr il ae sa in pk bd lk cn hk tw jp kr sg my th vn id ph au nz ca us mx br ar cl pe uy za eg ma ng ke""".split()
)
FIRST_NAMES = frozenset(
    """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen
    christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle
    anna peter maria jean pierre marie michel claire sophie nicolas philippe isabelle hans karl klaus jürgen wolfgang ursula petra sabine stefan andreas
    juan carlos jose luis ana carmen antonio manuel francisco laura pablo elena giovanni giuseppe paolo francesca marco giulia ivan olga natasha sergei""".split()
)
CUES = {
    "email": "mail contact write reach address", "email_spelled": "mail contact write reach address", "ip": "ip host server address client login from", "card": "card visa master credit debit pay number",
    "phone": "phone tel call mobile cell fax dial", "phone_national": "phone tel call mobile cell fax dial", "ssn": "ssn social security tax", "iban": "iban account bank transfer", "name": "name signed dear mr. mrs. dr.",
}
COUNTER_CUES = ("version", "example", "isbn", "order", "sample", "dummy", "section", "article", "invoice", "noreply")
_CUES = {k: tuple(v.split()) for k, v in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _part(digits: str) -> int:
    """An address part's value; 999 for all of more than three digits. Zeros in front don't count, however many."""
    digits = digits.lstrip("0")
    return 999 if len(digits) > 3 else int(digits or 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in BASE, start, end), sorted: exact matches that pass their check."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1  # nothing before this sign can be in a later match
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if max(map(_part, m[0].split("."))) <= 255]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the further kinds."""
    out: list[tuple[int, int, int]] = []
    done = 0  # no local part reaches into the span before it, or across the sign before it
    for m in _AT.finditer(text):
        begin = m.start() - (m.start() > done and text[m.start() - 1] == " ")
        start = begin
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        done = m.start()
        if start < begin and (rest := _SPELLED.match(text, begin)):
            out.append((4, start, done := rest.end()))
    if _DIGIT.search(text):
        out += [(5, *m.span()) for m in _NATIONAL.finditer(text)]
        out += [(6, *m.span()) for m in _SSN.finditer(text)]
        out += [(7, *m.span()) for m in _IBAN.finditer(text)]
    if "ame is" in text or "r." in text or "s." in text or "igned," in text or "ontact" in text:
        out += [(8, *m.span(1)) for m in _NAME.finditer(text)]
    return out


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """The labelers' votes on a span, given what stands before and after it."""
    digits = "".join(c for c in span if c.isdigit())
    low, around = span.lower(), f"{before} {after}".lower()
    check = gazetteer = 0
    if kind in ("email", "email_spelled"):
        domain = re.sub(r" ?[\[(]dot[\])] ?", ".", re.split(r"@|[\[(]at[\])]", low)[-1]).strip(" .-")
        check = 1 if "." in domain and not domain.rsplit(".", 1)[1].isdigit() else -1
        gazetteer = 1 if domain in PROVIDERS else (domain.rsplit(".", 1)[-1] in SUFFIXES) * 1
    elif kind == "ip":
        parts = [_part(p) for p in span.split(".")]
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        gazetteer = -1 if parts[0] in (0, 10, 127) or parts[0] >= 224 or parts[:2] == [192, 168] else 0
    elif kind == "card":
        check = 1
        gazetteer = 1 if digits[0] == "4" or digits[:2] in ("34", "37", "51", "52", "53", "54", "55", "62", "65") or digits[:4] == "6011" else -1
    elif kind in ("phone", "phone_national"):
        check = 1 if len(digits) >= 10 else 0
        gazetteer = (1 if digits[0] in "1234567" else 0) if kind == "phone" else (-1 if digits[0] in "01" else 1)
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "iban":
        check = 1 if int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1 else -1
    else:
        gazetteer = 1 if low.split()[0] in FIRST_NAMES else 0
    if len(set(digits)) == 1 and len(digits) > 6:
        check = -1
    cue = 1 if any(c in around for c in _CUES[kind]) else 0
    counter = -1 if any(c in around for c in COUNTER_CUES) else 0
    left, right = before[-1:], after[:1]
    edges = -1 if left.isalnum() or right.isalnum() or left in "$#=/_" and left else 1
    return check, gazetteer, cue, counter, edges


def shape(span: str, before: str, after: str) -> str:
    """Discrete features: length class, class of the sign before and after, number of separators."""
    side = lambda c: "0" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"
    n = len(span)
    return f"{0 if n < 9 else 1 if n < 13 else 2 if n < 17 else 3 if n < 24 else 4}{side(before[-1:])}{side(after[:1])}{min(4, sum(not c.isalnum() for c in span))}"


def apart(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of more that overlap no base span and none that is taken before them, kind by kind.

    Spans of one kind don't overlap each other. taken: spans by their places, none overlapping another.
    """
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):  # base spans of different kinds may overlap: joined
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for kind in sorted({k for k, *_ in more}):
        ends = [e for _, e in taken]
        new = []
        for k, s, e in more:
            if k == kind:
                i = bisect_right(ends, s)  # the first that ends after s
                if i == len(taken) or taken[i][0] >= e:
                    new.append((s, e))
        out += [(kind, s, e) for s, e in new]
        taken = sorted([*taken, *new])
    return out


CANDIDATES = "array<struct<kind: int, start: bigint, end: bigint, votes: string, shape: string>>"
_CANDIDATES = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("shape", pa.string())]))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array of candidate spans with votes and features, base spans first."""

    def of(text: str | None) -> list[dict]:
        if not text:
            return []
        base = sorted(base_spans(text))
        rest = apart(base, more_spans(text))
        out = []
        for k, s, e in [*base, *sorted(rest)]:
            span, before, after = text[s:e], text[max(0, s - WINDOW) : s], text[e : e + WINDOW]
            out.append({"kind": k, "start": s, "end": e, "votes": "".join("-0+"[v + 1] for v in votes(KINDS[k], span, before, after)), "shape": shape(span, before, after)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t.as_py()) for t in part.column(1)], _CANDIDATES)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id long, found {CANDIDATES}")


class SpanModel:
    """Reliabilities of the labelers, by expectation-maximisation, and the span classifier trained on its posteriors."""

    def __init__(self, counts: list[tuple[int, str, str, int]]):
        kinds = sorted({k for k, *_ in counts})
        n = np.array([c for *_, c in counts], float)
        kind = np.array([kinds.index(k) for k, *_ in counts], int)
        vote = np.array([["-0+".index(c) for c in v] for _, v, _, _ in counts], int).reshape(-1, len(LABELERS))
        p = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(1) - 0.5))
        prior, rate = np.zeros(len(kinds)), np.zeros((2, len(kinds), len(LABELERS), 3))
        for _ in range(ROUNDS if len(n) else 0):
            for y, q in enumerate((1 - p, p)):
                rate[y] = 0.5
                for m in range(len(LABELERS)):
                    np.add.at(rate[y, :, m], (kind, vote[:, m]), n * q)
                rate[y] /= rate[y].sum(2, keepdims=True)
            of_kind = np.bincount(kind, n, len(kinds))
            prior = (np.bincount(kind, n * p, len(kinds)) + 1) / (of_kind + 2)
            odds = np.log(prior / (1 - prior))[kind]
            for m in range(len(LABELERS)):
                odds = odds + np.log(rate[1, kind, m, vote[:, m]] / rate[0, kind, m, vote[:, m]])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.reliability = {(KINDS[k], name): rate[1, i, m, 2] for i, k in enumerate(kinds) for m, name in enumerate(LABELERS)}
        self.posterior = {c[:3]: float(x) for c, x in zip(counts, p, strict=True)}
        names = sorted({f for k, v, s, _ in counts for f in self._features(k, v, s)})
        self.place = {f: i for i, f in enumerate(names)}
        x = np.array([[self.place[f] for f in self._features(k, v, s)] for k, v, s, _ in counts], int)  # a pattern has as many features as another
        w = np.zeros(len(names))
        for _ in range(25 if len(n) else 0):  # Newton's method with a ridge
            q = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
            g, h = -w, np.eye(len(names))
            for i in range(x.shape[1]):
                g = g + np.bincount(x[:, i], n * (p - q), len(names))
                for j in range(x.shape[1]):
                    np.add.at(h, (x[:, i], x[:, j]), n * q * (1 - q))
            step = np.linalg.solve(h, g)
            w = w + step
            if np.abs(step).max(initial=0) < 1e-6:
                break
        self.weights = w

    @staticmethod
    def _features(kind: int, vote: str, form: str) -> list[str]:
        return ["bias", f"k{kind}", *(f"v{m}{c}" for m, c in enumerate(vote)), *(f"k{kind}v{m}{c}" for m, c in enumerate(vote)), *(f"s{m}{c}" for m, c in enumerate(form)), f"k{kind}s{form[0]}"]

    def probability(self, kind: int, vote: str, form: str) -> float:
        z = sum(self.weights[self.place[f]] for f in self._features(kind, vote, form) if f in self.place)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(found: DataFrame) -> SpanModel:
    """The model for candidates(); the driver gets the counts of the distinct vote and feature patterns."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    return SpanModel(sorted(tuple(r) for r in each.collect()))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, probability) in the order of KINDS and places; base kinds are always there."""
    found = written(candidates(docs, id_col=id_col, text_col=text_col), "candidates")
    model = fitted(found)
    known = {key: model.probability(*key) for key in model.posterior}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                spans = [(c["kind"], c["start"], c["end"], known[c["kind"], c["votes"], c["shape"]]) for c in found]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "probability": p} for k, s, e, p in sorted(spans) if k < len(BASE) or p >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, probability: double>>")


def redacted(docs: DataFrame, **kw) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets. Ids must be distinct."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    spans = personal_data(docs, **kw).where(F.size("spans") > 0).withColumnRenamed("doc_id", id_col)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    both = docs.join(spans.select(id_col, by_start.alias("__spans")), id_col, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)

    def step(acc, s):
        skip = s["start"] < acc["at"]
        new = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(skip, acc).otherwise(F.struct(new.alias("out"), s["end"].alias("at")))

    done = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return both.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(done)).drop("__spans").select(docs.columns)


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the contract: counts and a hash of the base spans, all spans joined."""
    form = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda a: F.array_join(F.transform(a, form), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
