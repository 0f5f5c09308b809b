"""Operators 11 to 13 against plain readings of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from cohortlab.llm import fim, merkle, odd_sketch
from pyspark.sql import functions as F
from test_text_operators import docs, empty, rows, words  # noqa: F401

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_bits_mark_tokens():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab é日\n\t  \x1c\x85") for _ in range(rng.randint(0, 40)))
        data, tokens = text.encode(), TOKEN.findall(text)
        mask = fim.starts(data)
        at = [len("".join(tokens[:k]).encode()) for k in range(len(tokens))]
        assert mask.bit_count() == len(tokens) and [fim.select(mask, k, len(data)) for k in range(len(tokens))] == at
        n, i, j = fim.cuts(data, 7, 11)
        a, b = sorted((7 % (n + 1), 11 % (n + 1)))
        assert (data[:i].decode(), data[i:j].decode()) == ("".join(tokens[:a]), "".join(tokens[a:b]))


def fim_by_hand(doc, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= rate:
        return doc, len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_by_hand(spark, docs, rows, empty):  # noqa: F811
    for spm in (80, 0):
        more = spark.createDataFrame([(None, "no id here", "s", "k", 1, 2), (200, "a <M> b", "s", "k", 1, 2), (201, "z" * 300_000 + " 日本 " * 50_000, "s", "k", 1, 2)], docs.schema)
        out = fim.fill_in_middle(docs.unionByName(more).withColumns({"form": F.lit("x"), "n": F.lit("y"), "output": F.lit(1)}), rate=90, spm=spm)
        every = [(a, b) for a, b, _ in rows] + [(None, "no id here"), (200, "a <M> b"), (201, "z" * 300_000 + " 日本 " * 50_000)]
        assert Counter(tuple(r) for r in out.collect()) == Counter(fim_by_hand(a, b, rate=90, spm=spm) for a, b in every)
        back = Counter(r[0] for r in out.select(fim.restored()).collect())
        assert back == Counter(b or "" for _, b in every)
    assert fim.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, marks=("<<", "<", ">"))


def classes_by_hand(rows, threshold):  # noqa: F811
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] and rows[i][0] is not None and sets[i] and sets[j]
            linked = None not in (rows[i][0], rows[j][0]) and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
            if same or linked:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None else None
    return Counter((d, len(sets[i]), least[find(i)], d is None or d == least[find(i)]) for i, (d, _) in enumerate(rows))


def test_classes_by_hand(spark, docs, rows, empty):  # noqa: F811
    say = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    more = [(None, say("p")), (None, say("p")), (300, say("p")), (301, say("q")), (302, say("q")), (302, say("r")), (303, say("r") + " end"), (304, None), (304, "")]
    extra = spark.createDataFrame([(a, b, "s", "k", 1, 2) for a, b in more], docs.schema)
    own = docs.unionByName(extra).withColumns({"k1": F.lit("a"), "rep": F.lit(2), "sketch": F.lit(3), "component_id": F.lit(4)})
    every = [(a, b) for a, b, _ in rows] + more
    for threshold, block in ((0.85, 256), (0.8, 3), (0.9, 256)):
        got = Counter(tuple(r) for r in odd_sketch.near_duplicate_classes(own, threshold=threshold, block=block).collect())
        assert got == classes_by_hand(every, threshold)
    assert odd_sketch.near_duplicate_classes(empty).count() == 0


def test_classes_of_a_chain(spark):
    """Each text is near the next only: no text is near the least one but the second, so links come from pairs of blocks."""
    base = [f"w{i}" for i in range(600)]
    rows = [(100 + i, " ".join(base[8 * i : 8 * i + 200])) for i in range(40)]  # noqa: F811
    docs = spark.createDataFrame(rows, "doc_id long, text string")  # noqa: F811
    for block in (256, 4):
        got = Counter(tuple(r) for r in odd_sketch.near_duplicate_classes(docs, threshold=0.85, block=block).collect())
        assert got == classes_by_hand(rows, 0.85) and len({r[2] for r in got}) == 1


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    bands, per = odd_sketch.choose_bands(0.85)
    k = 2 * bands * per
    a = rng.integers(0, 2**32, (5000, k)).astype(np.uint32)
    for j in (0.85, 0.95):
        b = np.where(rng.random(a.shape) < 1 - j, rng.integers(0, 2**32, a.shape), a).astype(np.uint32)
        differ = np.bitwise_count(odd_sketch.sketches(a) ^ odd_sketch.sketches(b)).sum(axis=1)
        found = odd_sketch.similarity(differ, k)
        assert abs(found.mean() - j) < 0.003 and found.std() < 0.03 and differ.max() <= odd_sketch.most_bits(0.85, k)
    far = np.bitwise_count(odd_sketch.sketches(a) ^ odd_sketch.sketches(a[::-1])).sum(axis=1)
    assert far.min() > odd_sketch.most_bits(0.85, k)


def manifest_by_hand(rows, fanout):  # noqa: F811
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[2], r[3], r[4], r[1])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][q : q + fanout])) for q in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, i):
        out = []
        for nodes in levels[:-1]:
            q = i - i % fanout
            out += nodes[q:i] + nodes[i + 1 : q + fanout]
            i //= fanout
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[k])]) for k in keys]
    top = tree([t[-1][0] for t in trees])
    return Counter((x[3], x[2], t[-1][0], top[-1][0], sha("".join(siblings(t, i) + siblings(top, g)))) for g, (k, t) in enumerate(zip(keys, trees)) for i, x in enumerate(sorted(groups[k])))


def test_manifest_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, f"text {i}\nend" if i % 7 else None, rng.choice(["hot"] * 5 + ["a", "é", "日", "", None]), "en", i) for i in range(200)]  # noqa: F811
    rows += [(None, "no id", "hot", None, None), (5, "again", "hot", "en", 1), (5, "again", "hot", "en", 1), (900, "x" * 200_000, "alone", "en", 1), (901, "", "a", "", 0)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"leaf": F.lit(1), "n": F.lit(2), "r": F.lit(3), "root": F.lit(4)})  # noqa: F811
    for fanout, levels in ((3, 6), (3, 1), (2, 2)):
        out = merkle.merkle_manifest(docs, fanout=fanout, levels=levels).cache()
        assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"]) for r in out.withColumn("p", merkle.proof_digest()).collect()) == manifest_by_hand(rows, fanout)
        assert out.filter(merkle.fold("leaf", fanout) != F.col("root")).count() == 0
        assert out.filter(merkle.fold(F.sha2(F.col("leaf"), 256), fanout) == F.col("root")).count() == 0
    for some in (rows[:1], []):
        assert merkle.merkle_manifest(spark.createDataFrame(some, schema)).count() == len(some)


def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, f"one two\nthree {i}\n", f"s{i % 4}", "en", i) for i in range(60)] + [(70, None, None, None, None), (71, "", "s1", "en", 0), (72, "<P> mark", "s1", "en", 1), (73, " \n", "new", "en", 2)]  # noqa: F811
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query, sql in ((fim.op11_fim, fim.OP11_SQL), (merkle.op13_merkle, merkle.OP13_SQL)):
        got = query(spark, str(tmp_path))
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall()) and got.count() == len(rows)
    tampered = {d for d, t, *_ in rows if t and "\n" in t and zlib.crc32(str(d).encode()) % 2 == 0}
    assert {r["doc_id"] for r in merkle.op13_merkle(spark, str(tmp_path)).filter("not verified").collect()} == tampered


def test_likely_classes_hold_every_likely_pair(spark, monkeypatch):
    """Against all pairs, with few pairs at a time and small blocks."""
    from cohortlab.llm import sketch

    monkeypatch.setattr(sketch, "PAIRS", 10)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, (6, 60)).astype(np.uint32)
    low = np.where(rng.random((120, 60)) < rng.choice([0.05, 0.2, 0.4], (120, 1)), rng.integers(0, 2**32, (120, 60)), base[rng.integers(0, 6, 120)]).astype(np.uint32)
    marks, bands = sketch.sketches(low).view(np.int64), np.array([[hash(tuple(x[3 * b : 3 * b + 3])) for b in range(20)] for x in low.tolist()])
    reps = spark.createDataFrame([(i, b.tolist(), s.tolist()) for i, (b, s) in enumerate(zip(bands, marks))], "rep long, bands array<long>, sketch array<long>")
    root = list(range(120))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(120):
        for j in range(i):
            if (bands[i] == bands[j]).any() and np.bitwise_count((marks[i] ^ marks[j]).view(np.uint64)).sum() <= 40:
                root[find(i)] = find(j)
    for block in (256, 5):
        got = {r["node"]: r["root"] for r in sketch.likely_classes(reps, 20, 40, block).collect()}
        seen = {}
        for i in range(120):
            assert seen.setdefault(find(i), got.get(i, i)) == got.get(i, i)
        assert len(set(seen.values())) == len(seen) > 6
