"""Operator 8: URL filters by a bit-parallel wildcard automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, table

#: (host, path, verdict) as the query's contract fixes them.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: (category, host, path) globs of pages that rarely hold text worth training on: `*` is any run of
#: characters, `?` any one, neither leaves the host or the path. The host is matched with a dot before it.
BLOCKED = [
    *[("gambling", h, "*") for h in ("*casino*", "*poker*", "*betting*", "*-bets*", "*.bets*", "*jackpot*", "*roulette*", "*slots-*", "*-slots*", "*lottery*")],
    *[("adult", h, "*") for h in ("*porn*", "*.xxx", "*-xxx*", "*adult-*", "*-adult*", "*.adult.*", "*escort-*", "*-escort*", "*sexcam*", "*sex-*", "*-sex*", "*hentai*")],
    *[("advertising", h, "*") for h in ("*.ads.*", "*.ads-*", "*-ads.*", "*.ad?.*", "*adserver*", "*adservice*", "*.banner?.*", "*clicktrack*", "*-track.*", "*.tracker.*", "*-tracker*", "*.tracking.*", "*-tracking*", "*affiliate-*", "*popunder*")],
    *[("pharmacy", h, "*") for h in ("*-pills*", "*pills-*", "*viagra*", "*cialis*", "*-pharmacy*", "*pharmacy-*", "*-meds.*", "*steroids*")],
    *[("spam", h, "*") for h in ("*.spam*", "*-spam*", "*spam-*", "*linkfarm*", "*link-farm*", "*payday-loan*", "*free-download*", "*warez*", "*keygen*", "*replica-watch*", "*essay-writ*", "*-seo-*")],
    *[("page", "*", p) for p in ("/ads/*", "*/ads/*", "*/adclick*", "*/banners/*", "*/wp-login*", "*/wp-admin/*", "*/cgi-bin/*", "*/login*", "*/signin*", "*/signup*", "*/register*", "*/cart*", "*/checkout*", "*/logout*", "*/xmlrpc*")],
    *[("file", "*", f"*.{x}") for x in ("exe", "msi", "dmg", "apk", "zip", "rar", "7z", "gz", "iso", "mp3", "mp4", "avi", "jpg", "png", "gif", "css", "js")],
]
SEP = "\n"
UNRESERVED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-._~"


class GlobAutomaton:
    """All patterns packed one after the other into multiword Shift-And masks.

    Bit i stands for the i-th symbol of the packed patterns (`*` is no symbol but a self-loop on
    the state before it). A step over one character takes a shift, an and, and the self-loops for
    every pattern and every text of a batch at once. Neither `*` nor `?` takes a SEP.
    """

    def __init__(self, patterns: list[str]):
        start, final, loops, symbols = [], [], [], []
        for pattern in patterns:
            start.append(len(symbols))
            symbols.append(None)  # the state before the first character
            for c in pattern:
                if c == "*":
                    loops.append(len(symbols) - 1)
                else:
                    symbols.append(c)
            final.append(len(symbols) - 1)
        self.words = max(1, (len(symbols) + 63) // 64)
        self.start, stay, self.ends = self._bits(start), self._bits(loops), [(x // 64, np.uint64(x % 64)) for x in final]
        anyone = [i for i, s in enumerate(symbols) if s == "?"]
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({SEP} | {s for s in symbols if s and s != "?"}))}
        self.masks = np.stack([self._bits(anyone), *[self._bits([*(anyone if c != SEP else []), *[i for i, s in enumerate(symbols) if s == c]]) for c in self.alphabet]])
        self.stay = np.stack([stay] * len(self.masks))
        self.stay[self.alphabet[SEP]] = 0

    def _bits(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, texts: list[str], batch: int = 4096) -> np.ndarray:
        """A boolean row of patterns for each text; whole texts must match."""
        out = np.empty((len(texts), len(self.ends)), bool)
        for i in range(0, len(texts), batch):
            out[i : i + batch] = self._match(texts[i : i + batch])
        return out

    def _match(self, texts: list[str]) -> np.ndarray:
        order = np.argsort([-len(x) for x in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        codes = [np.fromiter((self.alphabet.get(c, 0) for c in texts[i]), np.int64, len(texts[i])) for i in order]
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -k, side="left"))  # texts longer than k come first
            now = state[:live]
            at = np.fromiter((c[k] for c in codes[:live]), np.int64, live)
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.masks[at]
            state[:live] = moved | (now & self.stay[at])
        out = np.empty((len(texts), len(self.ends)), bool)
        for p, (w, b) in enumerate(self.ends):
            out[order, p] = (state[:, w] >> b) & one != 0
        return out


def canonical(host: str, path: str) -> tuple[str, str]:
    """The host without user, port and closing dots; the path in lower case, with codes of unreserved
    characters decoded and runs of slashes made one."""
    host = re.sub(r"\.+\Z", "", re.sub(r":[0-9]*\Z", "", re.sub(r"\A[^@]*@", "", host)))
    path = path.translate(_LOWER)
    if "%" in path:
        for c in UNRESERVED:
            path = path.replace(f"%{ord(c):02x}", c.lower())
    return host, re.sub("/{2,}", "/", path) if "//" in path else path


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path of a URL; both empty for null or where there is no `://`."""
    at = df.withColumn("_u", F.coalesce(F.col(url), F.lit(""))).withColumn("_r", F.expr("if(instr(_u, '://') > 0, substr(_u, instr(_u, '://') + 3), '')"))
    at = at.withColumn("_h", F.regexp_extract("_r", r"(?s)^[^/?#]*", 0))
    return at.withColumns({"host": ascii_lower(F.col("_h")), "path": F.regexp_extract(F.expr("substr(_r, length(_h) + 1)"), r"(?s)^[^?#]*", 0)}).drop("_u", "_r", "_h")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[tuple[str, str, str]] = BLOCKED) -> DataFrame:
    """Adds host, path, rule, verdict and globs (the numbers of the globs in `blocked` that match).

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with the
    rule's; the longest decides. All rules and globs run in one automaton, rules over host and path
    as they stand, globs over the canonical url. Null urls and urls without `://` have empty host and path, no
    rule, and are allowed unless a glob matches the empty text. Every row is judged on its own, so
    ties and repeated rows get equal verdicts. Columns of the input with the added names are
    replaced, all others stay. An empty table gives an empty result.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), [-ord(c) for c in r[0] + SEP + r[1]]))
    automaton = GlobAutomaton([f"*.{h}{SEP}{p}*" for h, p, _ in ordered] + [h + SEP + p for _, h, p in blocked])
    n = len(ordered)
    src = host_path(pages.drop("host", "path", "rule", "verdict", "globs"))
    added = [T.StructField("globs", T.ArrayType(T.IntegerType())), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = list(zip(pdf["host"], pdf["path"]))
            plain = [canonical(*x) for x in raw]
            hit = automaton.match([f".{h}{SEP}{p}" for h, p in raw])
            other = [i for i, (x, y) in enumerate(zip(raw, plain)) if x != y]
            hit[other, n:] = automaton.match([f".{h}{SEP}{p}" for h, p in (plain[i] for i in other)])[:, n:]
            first = [int(r[:n].argmax()) if r[:n].any() else None for r in hit]
            globs = [np.flatnonzero(r[n:]).astype("int32") for r in hit]
            rule = [None if i is None else ordered[i][0] + ordered[i][1] for i in first]
            verdict = [("block" if len(g) else "allow") if i is None else ordered[i][2] for i, g in zip(first, globs)]
            yield pdf.assign(globs=globs, rule=pd.Series(rule, dtype=object, index=pdf.index), verdict=pd.Series(verdict, dtype=object, index=pdf.index))

    return src.mapInPandas(run, T.StructType([*src.schema.fields, *added]))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_like(glob: str) -> str:
    """A glob as a regular expression of a whole text."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def _sql_path(x: str) -> str:
    for c in UNRESERVED:
        x = f"replace({x}, '%{ord(c):02x}', '{c.lower()}')"
    return f"regexp_replace({x}, '/+', '/', 'g')"


OP8_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS hh FROM r),
p AS (SELECT page_id, translate(hh, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(hh) + 1), '^[^?#]*') AS path FROM h),
c AS (SELECT *, '.' || regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '\.+$', '') AS ch,
  {_sql_path("translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS cp FROM p),
v AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IN ('com/fr/', 'org/') THEN 'allow'
  WHEN {" OR ".join(f"regexp_matches(ch, '{_sql_like(h)}')" if p == "*" else f"regexp_matches(cp, '{_sql_like(p)}')" for _, h, p in BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict
FROM v"""
