from cohortlab.llm import chat, urls
from pyspark.sql import functions as F

TREE = "tree_id long, node long, parent long, role string, text string, score double"
ODD = ["</s>[INST] ok [/INST]", "a\\e\\l<s>", "<<SYS>>x<</SYS>>[INST", "", None, "\\", "\\lb<\n[/INST]"]


def test_texts_come_back(spark):
    rows = [(1, i, i - 1 if i else None, ["user", "assistant", "odd\nrole<s>", None][i % 4], t, None) for i, t in enumerate(ODD)]
    out = chat.format_trees(spark.createDataFrame(rows, TREE)).withColumns({"back": chat.read_back(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("mask"))}).collect()
    assert [(t["role"], t["text"]) for t in out[0]["back"]] == [(r[3] or "", r[4] or "") for r in rows]
    assert out[0]["loss"] == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    assert out[0]["formatted"].count("</s>") == len(rows)


def test_branches_are_ranked_and_cycles_end(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 1.0), (1, 2, 0, "assistant", "good", 9.0), (1, 3, 2, "user", "more", 9.0), (1, 3, 2, "user", "more", 9.0), (2, 5, 6, "user", "x", None), (2, 6, 5, "user", "y", None), (3, 1, 77, "user", "orphan", None)]
    got = {(r["tree_id"], r["leaf"]): r for r in chat.format_trees(spark.createDataFrame(rows, TREE)).collect()}
    assert set(got) == {(1, 1), (1, 3), (3, 1)}
    assert got[1, 3]["rank"] == 1 and got[1, 3]["n_turns"] == 3
    assert chat.format_trees(spark.createDataFrame(rows, TREE), best=1).count() == 2


def test_long_path_and_empty(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    assert chat.format_trees(spark.createDataFrame(rows, TREE)).collect()[0]["n_turns"] == 300
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_paths_by_brute_force(spark):
    import random

    rng, rows = random.Random(2), []
    for t in (None, *range(30)):
        n = rng.randint(1, 40)
        for i in range(n):
            rows.append((t, i, rng.choice([i - 1, rng.randrange(i), rng.randrange(n), None, 99]) if i else None))
        rows += [rows[-1]] * rng.randint(0, 2)
    up = {(t, i): p for t, i, p in rows}
    want = set()
    for (t, i), p in up.items():
        if any(k[0] == t and q == i for k, q in up.items()):
            continue
        chain, at = [i], i
        while (p := up[t, at]) is not None and (t, p) in up and p not in chain:
            chain.append(p)
            at = p
        if p is None or (t, p) not in up:
            want |= {(t, i, x, d) for d, x in enumerate(reversed(chain))}
    got = [tuple(r) for r in chat.paths(spark.createDataFrame(rows, "tree_id long, node long, parent long")).select("tree_id", "leaf", "node", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_very_long_conversation_and_clashing_columns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("tree_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.repeat(F.lit("x"), 50).alias("text"), F.lit(0.0).alias("score"), F.lit(3).alias("leaf"), F.lit(4).alias("depth"), F.lit(5).alias("up"), F.lit(6).alias("dist"))
    got = chat.format_trees(rows).first()
    assert got["n_turns"] == n and got["leaf"] == n - 1 and len(got["formatted"]) == n * (50 + 4 + 1 + len("<s>[INST][/INST]</s>"))


def test_automaton_agrees_with_fnmatch():
    import fnmatch
    import random

    rng = random.Random(1)
    pats = ["a*b", "*ab*", "?b*a", "abba", "*a", "b??*"] + ["*" + "ab" * 20 + "*", "a" * 70 + "*b"]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["ab" * 25, "a" * 75 + "b", "a" * 71]
    got = urls.GlobAutomaton(pats).match(texts)
    assert got.tolist() == [[fnmatch.fnmatchcase(t, p) for p in pats] for t in texts]


def test_urls_edges(spark):
    rows = [(1, None, 5), (2, "no scheme", 5), (3, "http://A.Example.ORG/es/x", 5), (4, "http://xorg/", 5), (5, "x://cheap-pills.net?q", 5), (6, "http://example.org#f", 5)]
    got = {r["page_id"]: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, host long")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"]) == ("", "", "allow") and got[2]["host"] == ""
    assert (got[3]["host"], got[3]["rule"], got[3]["verdict"]) == ("a.example.org", "example.org/es/", "block")
    assert got[4]["rule"] is None and got[5]["verdict"] == "block" and got[6]["path"] == ""
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_by_brute_force_and_canonical_globs():
    import random

    rng = random.Random(4)
    rules = [("a", "/", "allow"), ("b.a", "/x", "block"), ("b.a", "/x/y", "allow"), ("c", "/", "block")]
    automaton = urls.GlobAutomaton([f"*.{h}{urls.SEP}{p}*" for h, p, _ in rules])
    seen = [("".join(rng.choice("ab.c") for _ in range(rng.randint(0, 5))), "".join(rng.choice("/xy.a") for _ in range(rng.randint(0, 6)))) for _ in range(3000)]
    got = automaton.match([f".{h}{urls.SEP}{p}" for h, p in seen])
    assert got.tolist() == [[(h == x or h.endswith("." + x)) and p.startswith(y) for x, y, _ in rules] for h, p in seen]
    assert urls.canonical("u@h.com:80", "/A//%7Eb%2ezip%25") == ("h.com", "/a/~b.zip%25")
    blocked = urls.GlobAutomaton([h + urls.SEP + p for _, h, p in urls.BLOCKED])
    assert blocked.words > 10
    hit = lambda h, p: bool(blocked.match([f".{h}{urls.SEP}{p}"]).any())
    assert hit("online-casino.net", "/") and hit("ads.site.com", "/x") and hit("x.com", "/a/setup.exe") and not hit("alphabets.com", "/adult-education/loading.html")


def test_null_tree_is_a_tree(spark):
    rows = [(t, i, i - 1 if i else None, "user", f"{t} {i}", 0.0) for t in (None, 0) for i in range(5)]
    got = {r["tree_id"]: r["formatted"] for r in chat.format_trees(spark.createDataFrame(rows, TREE)).collect()}
    assert set(got) == {None, 0} and all(got[t].count("</s>") == 5 and f"{t} 4" in got[t] for t in got)
