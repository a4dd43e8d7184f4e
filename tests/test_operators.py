import math

import pytest
from pyspark.sql import functions as F

from strata.operators import docs, drift, entity, graphs, hashing, ranking, records, search, web


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_against_the_formula(spark):
    texts = ["red fox red", "blue fox", "red sky at night", None, "", "fox fox fox red"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    toks = [(t or "").split() for t in texts]
    mean, n = sum(map(len, toks)) / len(toks), len(toks)
    want = []
    for i, t in enumerate(toks):
        if "red" in t and "fox" in t:
            s = 0.0
            for w in ("red", "fox"):
                d = sum(w in x for x in toks)
                idf = math.log((n - d + 0.5) / (d + 0.5))
                idf = idf if idf > 0 else 1e-6
                s -= idf * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
            want.append((i, round(s, 6)))
    assert rows(search.bm25(df, "k", F.col("text"), "red fox"), "k", "score") == want
    assert search.bm25(df, "k", F.col("text"), "!!!").count() == 0
    assert search.bm25(df.limit(0), "k", F.col("text"), "red").count() == 0
    assert rows(search.bm25(df, "k", F.col("text"), "re", prefix=True), "k")[0] == (0,)
    p = search.search_postings(search.postings(df, "k", F.col("text")), "k", ["red", "fox"], n, mean)
    assert rows(p, "k", "score") == want


def test_phrase_overlaps_count(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, "b a")], "k int, text string")
    assert rows(search.bm25(df, "k", F.col("text"), "a.b.a"), "k") == [(1,)]


def test_knn_filters_after(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [2.0, 0.0], 1), (4, None, 1), (5, [1.0], 1)], "k int, v array<float>, label int")
    assert rows(search.knn(df, "k", "v", [0.0, 0.0], 2), "k") == [(1,), (2,)]
    assert rows(search.knn(df, "k", "v", [0.0, 0.0], 2, F.col("label") == 1), "k") == [(1,)]


def test_like_checks_columns(spark):
    df = spark.createDataFrame([(1, "50% off_", None)], "k int, a string, b string")
    assert search.like(df, ["a", "b"], "% OFF_").count() == 1
    with pytest.raises(ValueError):
        search.like(df, ["c"], "x")


def test_dedup_and_edges(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "z")], "n int, k string, v string")
    assert rows(hashing.keep_first(df, ["k"], ["n"]).where("k is not null"), "k", "n", "v") == [("a", 1, "y"), ("b", 2, None)]
    assert rows(hashing.duplicate_edges(df, "n", F.col("k")), "duplicate", "first", "n") == [(3, 1, 2)]
    again = hashing.insert_ignore(df, df, ["k"], ["n"])
    assert again.where("k is not null").count() == 0


def test_diffs(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "k string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "4")], "k string, h string")
    assert rows(drift.diff(a, b, "k", "h"), "k", "state") == [("w", "added"), ("x", "current"), ("y", "changed"), ("z", "removed")]
    assert rows(drift.registry_diff(a, b, "k", "h"), "k", "state") == [("x", "unchanged"), ("y", "new"), ("z", "missing")]
    assert rows(drift.reconcile(a, b, "k", ["h"]), "k", "field") == [("z", "(missing)")]
    up = drift.upsert(a, b, "k", ["h"])
    assert rows(up, "k", "h", "changed") == [("w", "4", True), ("x", "1", False), ("y", "2", True), ("z", "3", False)]


def test_islands(spark):
    df = spark.createDataFrame([("u", i, c) for i, c in enumerate("bbgbbbg")], "u string, i int, c string")
    assert rows(drift.streak_islands(df, "u", "i", F.col("c") == "b", 3), "first", "last", "n") == [(3, 5, 3)]


def test_best_match_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    pool = [f"w{i}" for i in range(12)]
    left = [(i, " ".join(rng.sample(pool, rng.randint(1, 5)))) for i in range(60)]
    right = [(i, " ".join(rng.sample(pool, rng.randint(1, 5)))) for i in range(60)]
    want = []
    for k, a in left:
        best = None
        for r, b in right:
            x, y = set(a.split()), set(b.split())
            s = (1, 1.0) if a == b else (0, len(x & y) / len(x | y))
            if s[1] >= 0.65 and (best is None or (-s[0], -s[1], r) < best):
                best = (-s[0], -s[1], r)
        if best:
            want.append((k, best[2], round(-best[1], 6)))
    got = entity.best_match(spark.createDataFrame(left, "l int, name string"), spark.createDataFrame(right, "r int, name string"), "l", "r", "name")
    assert rows(got, "l", "r", "score") == sorted(want)


def test_merge_gains_an_id(spark):
    data = [("b", 1, None, "oak", "x", None, "s1"), ("b", 2, "7", "oak", None, "t", "s2"), ("b", 3, "7", "other", "q", "u", "s3"), ("c", 1, "7", "oak", "x", None, None)]
    df = spark.createDataFrame(data, "block string, n int, id string, name string, f string, g string, src string")
    got = entity.merge(df, "block", "n", "id", "name", ["f", "g"], "src")
    assert rows(got, "block", "id", "name", "f", "g", "n_rows") == [("b", "7", "oak", "x", "t", 3), ("c", "7", "oak", "x", None, 1)]


def test_top_two_ties(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha alpha")], "k int, t string")
    s = ranking.cue_scores(df, "k", F.col("t"), [("a", "alpha", 2), ("b", "beta", 2)])
    assert rows(ranking.top_two(s, "k"), "k", "first", "margin", "confidence") == [(1, "a", 0, "low"), (2, "a", 0, "low"), (3, "a", 2, "high")]


def test_winner_and_overlay(spark):
    c = spark.createDataFrame([("q", "s1", 50, "Yes"), ("q", "s2", 40, "no"), ("q", "s3", 10, " yes ")], "claim string, id string, r int, v string")
    assert rows(ranking.winners(c, "claim", "r", "id", "v"), "winner", "n_candidates", "n_conflicts", "n_close") == [("s1", 3, 1, 1)]
    base = spark.createDataFrame([("k", "a", ""), ("k", "b", "B")], "k string, field string, value string")
    layers = spark.createDataFrame([("k", "a", "sets", "low", 1), ("k", "a", "sets", "high", 2), ("k", "b", "sets", "no", 1), ("k", "b", "adds", "x", 1), ("k", "c", "overrides", "1", 1), ("k", "c", "overrides", "2", 2)], "k string, field string, mode string, value string, rank int")
    assert rows(ranking.overlay(base, layers, "k"), "field", "value") == [("a", "low"), ("b", "B;x"), ("c", "2")]


def test_web(spark):
    html = '<link href="/f" type="application/rss+xml"><a href="http://U:p@WWW.x.org:80/a#b">1</a><a href="http://U:p@WWW.x.org:80/a">2</a><a href="mailto:q">m</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    got = {r.k: (list(r.l), list(r.f)) for r in df.select("k", web.links(F.col("html")).alias("l"), web.feed_links(F.col("html")).alias("f")).collect()}
    assert got == {1: (["/f", "http://U:p@WWW.x.org:80/a"], ["/f"]), 2: ([], [])}
    assert df.limit(1).select(web.host(F.lit("http://U:p@WWW.x.org:80/a")).alias("h")).first().h == "x.org"
    assert web.blocks_of("<h1>A</h1>out<p>B <script>x</p></script>c<li>D") == [("h1", "A"), ("p", "B c"), ("li", "D")]
    table = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c<table><tr><td>in</td></tr></table></td><td>d</td></tr></table>"
    cells = web.tables_of(table)
    assert [c[:3] for c in cells[0]] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d")] and [c[:3] for c in cells[1]] == [(0, 0, "in")]
    rss = "<rss><channel><item><title>T</title><link>L</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>T</title><link href="L"/><updated>d</updated></entry></feed>'
    assert web.feed_entries(rss) == [("L", "T", "L", None, None)] and web.feed_entries(atom) == [("i", "T", "L", None, "d")] and web.feed_entries("<x") == []
    assert web.decoded("naïve".encode("cp1252")) == "naïve" and web.decoded("﻿é".encode("utf-16")) is not None and web.decoded(None) is None
    assert web.decoded(b"caf\xe9 \x93q\x94", "latin-1") == "café “q”"
    base = spark.createDataFrame([(1, "http://a/b/c", "../d")], "k int, base string, link string")
    assert web.absolute(base, "k", "base", "link").first().url == "http://a/d"


def test_docs(spark):
    text = "# Title\n\nOne\ntwo\n\n\n## Sub\n\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    assert rows(docs.paragraphs(df, "k", "text"), "k", "kind", "level", "text") == [(1, "heading", 1, "Title"), (1, "heading", 2, "Sub"), (1, "paragraph", 0, "One two")]
    md = "| a | b |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |"
    assert [t[:4] for t in docs.markdown_table(md)] == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, ""), (0, 2, 0, "2"), (0, 2, 1, "3")]
    csv = spark.createDataFrame([(1, '﻿a, b\n"x\ny",2\n')], "k int, text string")
    assert rows(docs.csv_cells(csv, "k", "text"), "row", "col", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "x\ny"), (1, 1, "2")]
    ics = "BEGIN:VEVENT\nSUMMARY:A\\, b\n c\nATTENDEE;CN=Ann:mailto:a@x\nEND:VEVENT"
    got = docs.calendar_events(spark.createDataFrame([(1, ics)], "k int, text string"), "k", "text").first()
    assert (got.summary, got.attendees) == ("A, bc", ["Ann"])
    eml = "From: a@example.com\nTo: b@example.com\nSubject: Hi\n\nBody"
    assert docs.mails(spark.createDataFrame([(1, eml), (2, None)], "k int, text string"), "k", "text").first().body == "Body"


def test_walk_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    seed = spark.createDataFrame([("a",)], "a string")
    w = graphs.layers(edges, seed, 10)
    assert (w.stop, rows(w.reached, "node", "layer")) == ("frontier_exhausted", [("a", 0), ("b", 1), ("c", 2), ("d", 3)])
    assert graphs.layers(edges, seed, 1).stop == "depth_cap" and graphs.layers(edges, seed, 10, 2).stop == "size_cap"


def test_records(spark):
    df = spark.createDataFrame([(1, " k "), (2, None), (3, "9")], "n int, g string")
    scale = spark.createDataFrame([("K", "Kindergarten"), ("9", "")], "f string, t string")
    assert {(r.n, r.translated) for r in records.translate(df, F.col("g"), scale, "f", "t").collect()} == {(1, "Kindergarten"), (2, None), (3, None)}
    bad = spark.createDataFrame([("123-45-6789 and 555-123-4567",), ("444.123.4567",), (None,)], "t string")
    assert [list(r[0]) for r in bad.select(records.rule_failures(F.col("t"))).collect()] == [["no_real_pii"], ["placeholder_pii"], []]
    with pytest.raises(ValueError):
        records.package(df, "n", {}, ["x"])


def test_captures(spark):
    df = spark.createDataFrame([("u", 1, "a b c", 0.1), ("u", 2, "a b c d", 0.9), ("u", 3, None, None)], "k string, o int, t string, c double")
    r = web.best_capture(df, "k", "o", "t", "c").first()
    assert (r.best, r.n) == (2, 3) and 0 < r.agreement < 1
    got = web.likeness(spark.createDataFrame([("abcd", "abxd"), (None, "a")], "x string, y string"), "x", "y").collect()
    assert [g.likeness for g in got] == [0.75, None]


def test_walk_keeps_gaps_and_stops(spark):
    from strata.operators import traverse

    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("bad", "x")], "ref string, to string")

    def page(seeds):
        got = seeds.join(edges, "ref", "left")
        return got.select("ref", F.lit("page").alias("next_kind"), F.col("to").alias("next_ref"), F.when(F.col("ref") == "bad", "broken").alias("error"))

    seeds = spark.createDataFrame([("page", "a"), ("page", "a"), ("page", "bad"), ("mail", "m"), (None, "n")], "kind string, ref string")
    found, gaps, why = traverse.run(seeds, {"page": page})
    assert sorted((r.layer, r.ref, r.n_next) for r in found.collect()) == [(0, "a", 2), (1, "b", 1), (1, "c", 1), (2, "d", 0)]
    assert sorted((r.layer, r.ref, r.reason) for r in gaps.collect()) == [(0, "bad", "fetch_error"), (0, "m", "no_fetcher")] and why == "saturated"
    assert traverse.run(seeds, {"page": page}, max_layers=2)[2] == "max_layers" and traverse.run(seeds, {"page": page}, max_findings=1)[2] == "max_findings"
    empty = traverse.run(seeds.limit(0), {"page": page})
    assert empty[2] == "exhausted" and traverse.envelope(*empty).first()["findings"] == 0


def test_index_is_found_again(spark, tmp_path):
    from strata.operators import search

    df = spark.createDataFrame([(1, "Café menu for the Middle School"), (2, None), (3, "middle of the school cafe"), (4, "")], "id int, text string")
    path = search.build_index([("t", df, "id", F.col("text"))], str(tmp_path / "index"))
    keys = lambda q, **k: [r.key for r in search.search_index(spark, path, q, **k).collect()]
    assert sorted(keys("cafe")) == ["1", "3"] and keys("middle.school") == ["1"] and sorted(keys("schoo mid", prefix=True)) == ["1", "3"]
    assert keys("") == [] and keys("nothing") == [] and keys("cafe", source="u") == []


def test_engines(spark):
    from strata.plans import engines

    registry = engines.Registry("ocr")
    registry.register(engines.Engine("none", frozenset({"image"})))
    df = spark.range(2)
    assert {r.gap for r in registry.run(df, "image").collect()} == {"ocr:image"}
    registry.register(engines.Engine("reader", frozenset({"image"}), lambda x: x.withColumn("text", F.lit("t"))))
    assert registry.select("image").name == "reader" and registry.select("audio") is None and registry.run(df, "image").columns == ["id", "text"]


def test_located_tables_and_runs(spark):
    from strata.operators import extract

    page = "<table><tr><td>Title</td></tr><tr><th>Name</th><th> ID </th></tr><tr><td>a <b>b</b></td><td>1</td></tr><tr><td>c</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table><tr><td>x</td></tr></table>")], "n int, html string")
    got = {r.n: r.r for r in df.select("n", extract.located(extract.table_rows(F.col("html")), ["name", "id"]).alias("r")).collect()}
    assert got == {1: [{"name": "a b", "id": "1"}, {"name": "c", "id": None}], 2: [], 3: []}


def test_manifest_counts_repeats_and_ignores_order(spark):
    from strata.sources.files import manifest

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "n int, t string"), spark.createDataFrame([(2, None), (1, "x")], "n int, t string")
    one = lambda df: tuple(manifest(df, ["n"]).first())
    assert one(a) == one(b) != one(a.union(a.limit(1))) and one(a.limit(0))[0] == 0


def test_entities_join_over_any_key_and_number_of_steps(spark):
    """Chains over id and name, blanks that link nothing, hot keys, all across blocks."""
    data = [(1, "A", None, None), (2, "a ", "x", "f"), (3, None, "X", "g"), (4, "", "", "h"), (5, None, None, "i"), (6, "B", "y", ""), (7, "C", "y", "k"), (8, "C", "z", None), (9, None, "z", "l")]
    data += [(100 + i, f"k{i // 2}", f"n{(i + 1) // 2}", None) for i in range(41)] + [(1000 + i, "hot", None, str(i)) for i in range(200)]
    df = spark.createDataFrame(data, "n int, id string, name string, f string").withColumn("src", F.lit("s"))
    got = {r.n: r.entity for r in entity.components(df, "n", ["id", "name"]).collect()}
    assert [got[i] for i in range(1, 10)] == [1, 1, 1, 4, 5, 6, 6, 6, 6]
    assert {got[100 + i] for i in range(41)} == {100} and {got[1000 + i] for i in range(200)} == {1000}
    whole = {r.entity: (r.id, r.name, r.f, r.n_rows) for r in entity.merged(df, "n", ["id", "name"], ["f"], "src").collect()}
    assert whole[1] == ("A", "x", "f", 3) and whole[6] == ("B", "y", "k", 4) and whole[4] == (None, None, "h", 1) and whole[1000][3] == 200
    assert entity.merged(df.limit(0), "n", ["id", "name"], ["f"], "src").count() == 0


def test_routing_in_the_row_equals_routing_by_rows(spark):
    df = spark.createDataFrame([(1, "erosion and bus"), (2, None), (3, ""), (4, "bus bus vote"), (4, "bus bus vote")], "n int, t string")
    cues = [("a", "erosion", 2), ("b", "bus", 1), ("b", "vote", 1)]
    one = sorted(map(tuple, ranking.routed(df, "n", F.col("t"), cues).distinct().collect()))
    assert one == sorted(map(tuple, ranking.top_two(ranking.cue_scores(df.distinct(), "n", F.col("t"), cues), "n").collect()))
