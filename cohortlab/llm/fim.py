"""Operator 11: fill-in-middle transformation by big-integer bit-parallelism.

A text is one number with a bit for each byte. `bytes.translate` makes the mask of white space, a
shift of the word mask under it marks where tokens start, `bit_count` gives their number, and the
cuts are ranked bits, found by halving the number. No list of tokens is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARKS = ("<P>", "<S>", "<M>")
_SPACES = b" \t\n\v\f\r"
#: White space to 1, all other bytes (those of longer characters too) to 0.
_CLASS = bytes(49 if b in _SPACES else 48 for b in range(256))
OUT_BYTES = 8 << 20


def starts(data: bytes) -> int:
    """A number whose bit i is set where a token starts at byte i: at 0, and where white space follows a word."""
    if not data:
        return 0
    space = int(data[::-1].translate(_CLASS), 2)
    word = space ^ ((1 << len(data)) - 1)
    return space & (word << 1) | 1


def select(mask: int, k: int, width: int) -> int:
    """The place of the set bit of rank k (from 0) among `width` bits: halve, count the lower half, go on in one half."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - below, at + half
    return at


def cuts(data: bytes, one: int, two: int) -> tuple[int, int, int]:
    """(n, where the prefix ends, where the middle ends) in bytes, for two unsigned draws."""
    mask = starts(data)
    n = mask.bit_count()
    a, b = sorted((one % (n + 1), two % (n + 1)))
    place = lambda k: len(data) if k == n else select(mask, k, len(data))
    first = place(a)
    return n, first, first if a == b else place(b)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    n: tokens, each white space and the word after it, or white space at the end. form: plain
    (output is the text), psm or spm; of 100 texts `rate` are cut, `spm` of 100 of those as spm. All
    draws come from the sha256 of seed and doc_id, so a row gets the same cuts wherever and how
    often it runs; a null doc_id draws as an empty one, rows that share a doc_id share their draws. Null texts are empty; empty texts and those that hold a mark
    stay plain, so `restored` gives the exact text. A text of any length is cut in linear time and a few times its memory.
    Other columns are not read, so names don't clash; an empty table gives an empty result.
    """
    if len(set(marks)) < 3 or any(not m for m in marks) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("marks must be distinct, and no end of one may begin another")
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(names))

        out, size = [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id"), batch.column("key"), batch.column("text")):
                text = text.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                h = hashlib.sha256(f"{seed}:{key.as_py()}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
                n, i, j = cuts(data, h1, h2)
                if not data or h3 % 100 >= rate or p in data or s in data or m in data:
                    out.append((doc.as_py(), n, "plain", None, None, text))
                else:
                    a, b, c = data[:i], data[i:j], data[j:]
                    form = "spm" if h4 % 100 < spm else "psm"
                    made = s + c + p + a + m + b if form == "spm" else p + a + s + c + m + b
                    chars = [len(x.decode("utf-8", "surrogatepass")) for x in (a, b)]
                    out.append((doc.as_py(), n, form, *chars, made.decode("utf-8", "surrogatepass")))
                size += len(data)
                if size >= OUT_BYTES:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    p, s, m = (F.lit(x) for x in marks)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    head, middle = part(output, m, 1), part(output, m, 2)
    spm = F.concat(part(head, p, 2), middle, part(part(head, p, 1), s, 2))
    psm = F.concat(part(part(head, s, 1), p, 2), middle, part(head, s, 2))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
f AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
