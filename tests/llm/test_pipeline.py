import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
from cohortlab.llm import decontaminate, pii, quality, registry
from pyspark.sql import functions as F
from test_text_operators import all_spans, words


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = "/root/testdata/sf0.001"
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        assert out.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0, name
        if name != "mixing":
            assert out.columns == columns
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()
    assert stage(spark, docs.limit(0), d).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


def test_null_source_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.withColumn("doc_id", F.col("doc_id")), "/root/testdata/sf0.001").collect()


def test_documents_without_an_id(spark):
    d = "/root/testdata/sf0.001"
    held = spark.read.parquet(f"{d}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    rows = [(None, held, "en", "a", 0), (None, "a clean text", "en", "a", 0), (None, "a clean text", "en", "a", 0), (None, "another text", "en", None, 0), (None, None, None, None, None), (1, "with an id", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted(str(r["text"]) for r in df.collect())
    want = sorted(["None", "a clean text", "a clean text", "another text", "with an id"])
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()
    assert len(found) == len(rows) and [r["n_words"] for r in found if r["contaminated"]] == [max(r["n_words"] for r in found)]
    kept = corpus_pipeline.decontaminate_stage(spark, docs, d)
    assert texts(kept) == want and kept.columns == docs.columns
    mixed = corpus_pipeline.mixing_stage(spark, kept, d).cache()
    assert texts(mixed.filter("pass = 1")) == want and not {"_own", "_id", "_used"} & set(mixed.columns)


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, "something else entirely", "en", "a", 1), (None, text, "en", "a", 1), (4, None, "en", "a", 1), (5, text.upper() + " end", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == [1, 3, 4, None]


def test_pipeline_by_brute_force(spark):
    """Every stage's decisions on whole tables by other means: SQL, sets and dictionaries."""
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({quality.OP1_SQL})").fetchall() if k}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect() if r["doc_id"] in kept}
    # near duplicates: sets of five words
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := words(t))}
    where, root = defaultdict(list), {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in Counter((a, b) for own in where.values() for a in own for b in own if a < b).items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    texts = {i: t for i, t in texts.items() if find(i) == i}
    # decontamination: windows of ten words
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bench = {tuple(w[j : j + 10]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (w := split(r["text"])) for j in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in bench}
    texts = {i: t for i, t in texts.items() if not any(tuple(w[p : p + k]) in bench for w in [split(t)] for k in sizes for p in range(len(w) - k + 1))}
    texts = {i: pii.redact(texts[i], s) for i, s in all_spans(texts).items()}
    out = corpus_pipeline.run(spark, d).select("doc_id", "text", "n_chars", "pass").collect()
    assert {(r["doc_id"], r["text"]) for r in out} == set(texts.items()) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert Counter(r["doc_id"] for r in out if r["pass"] == 1) == Counter(list(texts))


def test_columns_of_users_stay(spark):
    """Names that operators add or use inside, and a text of a million characters."""
    d = "/root/testdata/sf0.001"
    names = ["kept", "n_words", "_key", "pii", "redacted", "tokens", "target", "passes", "rest", "class_id", "contaminated", "rejected_by", "a.b", "_beside_", "h", "c"]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40).select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    docs = docs.withColumn("text", F.when(F.col("doc_id") == docs.first()["doc_id"], F.repeat(F.lit("many words of one text\n"), 50_000)).otherwise(F.col("text"))).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        assert out.columns[: len(docs.columns)] == docs.columns and out.filter(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0, name
        assert out.count() > 0
    last = stage(spark, docs.withColumns({"pass": F.lit("x"), "block": F.lit("y")}), d)
    assert dict(last.dtypes)["pass"] != "string" and last.columns.count("pass") == 1


def test_mixing_keeps_columns(spark):
    from cohortlab.llm import mixing

    names = ["tokens", "target", "passes", "rest", "_key", "_blocks", "_n", "_order", "_source"]
    docs = spark.createDataFrame([(i, f"some words {i}", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs.withColumns({n: F.lit(n) for n in names}))
    assert out.filter(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0 and set(names) <= set(out.columns)
    plain = lambda df: sorted(tuple(r) for r in df.select("doc_id", "pass", "block", "place").collect())
    assert plain(out) == plain(mixing.mix_sources(docs))


def test_contexts_reach_any_distance():
    far = "reference code" + " " * 300 + "12345678"
    assert pii.context(far, far.index("1")) == "reference code"
    long = "see " + "x" * 250 + " 12345678"
    assert pii.context(long, long.index("1")) == "see " + "x" * 250
    assert pii.context("code 1234", 5) == "^ code" and pii.context("1234", 0) is None
    assert pii.context("a b " + ". " * 200 + "77", 404) == "a b"
