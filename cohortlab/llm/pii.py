"""Operator 9: personal data by fixed rules and bootstrapped contextual extraction.

Seeds (what the fixed rules find, and long hexadecimal keys) induce lexical patterns: the two
words before the whole of what was found. Spark scores the graph of patterns and instances in turns: a
pattern by the scores of its instances, an instance by those of its patterns. Whatever holds digits
and stands in the context of a high-confidence pattern is personal data too, seen before or not,
of any length, spaces included.

The texts are read once. What is kept of them is narrow: the places and hashes of candidates.
Patterns stay in tables and meet the candidates by joins.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_counted, row_key, table

KINDS = ("email", "ip", "card", "phone", "id")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the lookbehinds only skip starts inside a run of digits, whose first digit has failed before
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
# tokens with digits, one space apart; a token that closes a clause closes the run
_RUN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:(?<![,;:.!?|])\x20[^\s0-9]*+[0-9]\S*+)*+")
_EDGE = "\"'`()[]{}<>,;:.!?=|*#$%&"
_DIGITS = re.compile(r"[0-9]+")
_KEY = re.compile(r"[0-9A-Fa-f]{32,}")
CANDIDATE = "array<struct<start:int,end:int,pattern:long,instance:long,seed:boolean,base:boolean>>"
SPAN = "array<struct<start:int,end:int,kind:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the fixed rules' matches, sorted by start, then kind."""
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = at = m.end()
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def context(text: str, start: int, inside: str = "") -> str | None:
    """The two words before a place, however far before it, in lower case with digits as 0; `^` stands for a word before the text, None for two."""
    more, width = re.sub(r"([=:])", r" \1 ", inside).split(), 96
    while True:
        low = max(0, start - width)
        words = text[low:start].split()
        if low and words and not text[low - 1].isspace() and not text[low].isspace():
            del words[0]  # the part of a word
        plain = [_DIGITS.sub("0", x) for w in words + more if (x := w.strip("\"'`()[]{}<>,;.!?|*#$%&").lower())][-2:]
        if not low or len(plain) == 2:
            return " ".join(["^"] * (2 - len(plain)) + plain) if plain else None
        width *= 2


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, pattern, seed, base): the fixed rules' spans, and runs of tokens with digits beside them; only those with a word before them."""
    for start, end, _ in base:
        if pattern := context(text, start):
            yield start, end, pattern, True, True
    taken, at = sorted((s, e) for s, e, _ in base), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if any(s < end for s, _ in taken[at : at + 1]):
            continue
        body = m.group()
        # of "name=value" and "name: value" the value
        cut_at = max(body.rfind("=", 0, -1), body.rfind(":", 0, -1)) if " " not in body else -1
        inside = body[: cut_at + 1] if cut_at > 0 and _DIGITS.search(body, cut_at) else ""
        body = body[len(inside) :]
        begin = start + len(inside) + len(body) - len(body.lstrip(_EDGE))
        body = body.strip(_EDGE)
        if body and (pattern := context(text, start, inside)):
            yield begin, begin + len(body), pattern, bool(_KEY.fullmatch(body)), False


def _long(x: str) -> int:
    return struct.unpack("<q", hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fixed rules' spans and the candidates of each text."""
    for pdf in batches:
        spans, found = [], []
        for text in pdf["text"]:
            text = text if isinstance(text, str) else ""
            base = base_spans(text)
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            found.append([{"start": a, "end": b, "pattern": _long(p), "instance": _long(text[a:b]), "seed": s, "base": o} for a, b, p, s, o in candidates(text, base)])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "_key": pdf["_key"], "spans": spans, "found": found})


def score_patterns(edges: DataFrame, rounds: int, support: int) -> DataFrame:
    """edges: distinct (pattern, instance, seed). Returns (pattern, score, n).

    A pattern scores the sum of its instances' scores over one more than their number; an
    instance that is no seed scores the noisy-or of its patterns of at least `support` instances.
    Patterns and instances with many edges are split over tasks.
    """
    total = edges.count()
    by_instance = cut(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("c")))
    score = by_instance.withColumn("s", F.col("seed").cast("double"))
    patterns = None
    for turn in range(rounds):
        met = join_counted(edges.select("pattern", "instance"), score.select("instance", "c", "s"), ["instance"], total)
        patterns = cut(met.groupBy("pattern").agg((F.sum("s") / (F.count("*") + 1)).alias("score"), F.count("*").alias("n")))
        if turn < rounds - 1:
            good = F.when(F.col("n") >= support, F.least(F.col("score"), F.lit(0.999))).otherwise(F.lit(0.0))
            told = join_counted(edges.select("pattern", "instance"), patterns.withColumn("c", F.col("n")), ["pattern"], total)
            told = told.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - good)))).alias("_or"))
            score = cut(by_instance.join(told, "instance").select("instance", "c", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("_or")).alias("s")))
    return patterns


def find_spans(docs: DataFrame, rounds: int = 3, least: float = 0.6, support: int = 3) -> DataFrame:
    """(doc_id, _key, pii), a row for each row of docs; pii is the array of (start, end, kind)."""
    kept = docs.select("doc_id", "text", row_key().alias("_key")).mapInPandas(_read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _key string, spans {SPAN}, found {CANDIDATE}")
    kept = cut(kept)
    each = kept.select("_key", F.explode("found").alias("x")).select("_key", "x.*")
    edges = cut(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count_if(~F.col("base")).alias("others")))
    patterns = score_patterns(edges.select("pattern", "instance", "seed"), rounds, support)
    occurs = edges.groupBy("pattern").agg(F.sum("others").alias("c"))
    good = patterns.filter((F.col("n") >= support) & (F.col("score") >= least)).join(occurs, "pattern").select("pattern", "c")
    hit = join_counted(each.filter("not base").select("_key", "pattern", "start", "end"), good, ["pattern"], each.count())
    more = hit.groupBy("_key").agg(F.collect_set(F.struct("start", "end", F.lit("id").alias("kind"))).alias("more"))
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    every = F.concat("spans", F.coalesce("more", F.array().cast(SPAN)))
    ordered = F.transform(F.sort_array(F.transform(every, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("r"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return kept.join(more, "_key", "left").select("doc_id", "_key", ordered.alias("pii"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by <KIND>; of overlapping ones the first, and longest at one start, names the whole."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, rounds: int = 3, least: float = 0.6, support: int = 3) -> DataFrame:
    """Adds pii (array of start, end, kind) and redacted to each row of docs.

    Null texts are empty and stay null when redacted. Every row is treated on its own, also where
    a doc_id is null or shared, so repeated rows get equal spans. Columns named pii and redacted
    are replaced; all others stay. An empty table gives an empty result.
    """
    src = docs.drop("pii", "redacted").withColumn("_key", row_key())
    found = find_spans(docs, rounds, least, support).select("_key", "pii").dropDuplicates(["_key"])
    out = src.join(found, "_key").drop("_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [redact(t, [(x["start"], x["end"], x["kind"]) for x in p]) if isinstance(t, str) and len(p) else t for t, p in zip(pdf["text"], pdf["pii"])]
            # arrays of structs go back as they came
            pdf = pdf.assign(pii=[[{"start": x["start"], "end": x["end"], "kind": x["kind"]} for x in p] for p in pdf["pii"]])
            yield pdf.assign(redacted=pd.Series(texts, dtype=object, index=pdf.index))

    return out.mapInPandas(run, T.StructType([*out.schema.fields, T.StructField("redacted", T.StringType())]))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"] != "id")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("pii")).alias("spans"))
