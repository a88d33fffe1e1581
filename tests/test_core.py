"""Small fixtures with nulls, ties, repeated rows, empty tables and clashing columns for the core operators."""

from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ids, text
from quillspark.operators import changes, citing, edges, filters, fusion, graph, identity, quality, quota, segments, upserts
from quillspark.operators.components import connected_components
from quillspark.operators.orphans import find_orphans, orphan_report
from quillspark.session import hash_uniform, lookup
from quillspark.sources import payloads, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("https://doi.example/10.1234%2FAb.1", "10.1234/ab.1"), (" DOI: 10.1234/AB.1. ", "10.1234/ab.1"), ("info:doi/10.1234/ab.1", "10.1234/ab.1"), ("TBD", None), ("", None), (None, None), ("10.1234", None)],
)
def test_doi_key(spark, value, want):
    assert one(spark, value, ids.doi_key) == want


@pytest.mark.parametrize(("value", "want"), [("arxiv:2501.00001v3", "2501.00001"), ("http://arxiv.example/pdf/2003.50019.pdf", "2003.50019"), ("hep-th/9901001v2", "hep-th/9901001"), ("none", None), (None, None)])
def test_arxiv_key(spark, value, want):
    assert one(spark, value, ids.arxiv_key) == want


@pytest.mark.parametrize(("value", "want"), [("PMID: 00123", "123"), ("pmid77", "77"), ("https://pubmed.example/50244593/", "50244593"), ("50383085.0", "50383085"), ("n/a", None)])
def test_pmid_key(spark, value, want):
    assert one(spark, value, ids.pmid_key) == want


@pytest.mark.parametrize(("value", "want"), [("https://works.example/W90/", "W90"), ("w90 ", "W90"), ("  ", None), (None, None)])
def test_record_key(spark, value, want):
    assert one(spark, value, ids.record_key) == want


def test_orcid_and_urls(spark):
    assert one(spark, "0000-0002-1825-0097", text.orcid_ok) is True
    assert one(spark, "0000-0002-1825-0098", text.orcid_ok) is False
    assert one(spark, "https://a.example/x?api_key=abc&y=1", text.redacted) == "https://a.example/x?api_key=***&y=1"
    assert one(spark, "ftp://x", text.url_ok) is False
    assert one(spark, "=1+1", text.formula_safe) == "'=1+1"
    assert one(spark, " a ; ;b", text.list_cell) == ["a", "b"]
    assert one(spark, "10.1000/x", text.id_kind) == "doi"


def test_keys_and_years(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 1)], "x string, y int")
    keys = [r[0] for r in df.select(text.cache_key(F.col("x"), F.col("y"))).collect()]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 64
    assert text.year_range("2001-2003") == (2001, 2003) and text.year_range("1999") == (1999, 1999) and text.year_range("") == (None, None)
    with pytest.raises(ValueError):
        text.year_range("2003-2001")


def test_venues(spark):
    df = spark.createDataFrame([("Med Image Anal.", "Medical image analysis", True), ("Nature", "Science", False), ("", "", True), ("The A", "A", True)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.venues_equivalent(F.col("a"), F.col("b")), "want").collect())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=5), st.lists(st.sampled_from("abcdef"), max_size=5))
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(sorted(set(a)), sorted(set(b)))], "a array<string>, b array<string>")
    x, y = df.select(text.jaccard(F.col("a"), F.col("b")), text.jaccard(F.col("b"), F.col("a"))).collect()[0]
    want = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    assert x == y == pytest.approx(want)


REFS = "k string, ord bigint, reason string, at timestamp"
T0, T1, T2 = (datetime(2024, m, 1) for m in (1, 2, 3))


def test_orphans(spark):
    refs = spark.createDataFrame([("a", 1, "mine", T1), ("a", 1, "mine", T1), ("b", 2, "", T1), ("c", 3, "", T1), ("x", 4, "", T1), (None, 5, "", T1)], REFS)
    targets = spark.createDataFrame([("a", T2, None), ("b", T0, T1), ("b", T0, None), ("c", T0, T1), (None, T0, None)], "key string, loaded timestamp, deleted timestamp")
    got = find_orphans(refs, targets, [("k", "key")], deleted=F.col("deleted").isNotNull(), loaded=F.col("loaded"), at="at")
    # A column named reason is replaced.
    assert rows(got.select("ord", got.columns[-1])) == [(1, "late"), (1, "late"), (3, "deleted"), (4, "missing")]
    assert rows(orphan_report(got.select("ord", F.lit("t").alias("t")), ["t"])) == [("t", 4)]
    assert find_orphans(refs.limit(0), targets, [("k", "key")]).count() == 0
    assert find_orphans(refs, targets.limit(0), [("k", "key")]).count() == 5


@pytest.mark.parametrize(("match", "want"), [("simple", [3]), ("full", [2, 3, 4]), ("partial", [3, 4])])
def test_orphans_of_composite_keys(spark, match, want):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, None, "z"), (5, None, None)], "ord int, k1 string, k2 string")
    targets = spark.createDataFrame([("a", "x"), ("c", "y"), ("d", None)], "t1 string, t2 string")
    got = find_orphans(refs, targets, [("k1", "t1"), ("k2", "t2")], match=match)
    assert sorted(r["ord"] for r in got.collect()) == want


def test_lookup_with_hot_keys(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    hot = spark.createDataFrame([(7,)], "k bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(lookup(left, right, "k", how, hot)) == rows(left.join(right, "k", how))


def test_hash_uniform_is_within_bounds(spark):
    r = spark.range(20000).select(hash_uniform("id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).collect()[0]
    assert 0 < r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.02


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_connected_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in parent)
    got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == want


EV = "array<struct<source:string,source_id:string,source_url:string,collected_at:timestamp,confidence:double,raw_data:string>>"
PAPER = f"ord bigint, id string, title string, authors array<struct<author_id:string,name:string,position:int,affiliation:string>>, year int, venue string, venue_type string, abstract string, doi string, arxiv_id string, pmid string, url string, pdf_url string, citations bigint, reference_count bigint, keywords array<string>, evidence_list {EV}"


def paper(ord, id=None, title="A b c d e", names=(), year=2020, venue=None, doi=None, arxiv=None, url=None, conf=0.8, citations=None, keywords=(), abstract=None, kind=None):
    evidence = [("arxiv", None, "https://x.example", datetime(2025, 1, 1, tzinfo=timezone.utc), conf, None)] if conf is not None else []
    return (ord, id, title, [(None, n, i + 1, None) for i, n in enumerate(names)], year, venue, kind, abstract, doi, arxiv, None, url, None, citations, None, list(keywords), evidence)


def test_fuse_and_conflicts(spark):
    df = spark.createDataFrame([
        paper(1, "p", "T one", year=None, venue="", citations=3, keywords=["X"], conf=0.9), paper(2, "p", "T two", year=2001, venue="J. Neurosci.", citations=9, keywords=["x", "y"], conf=0.5),
        paper(3, "p", "T one", year=2010, venue="Other", conf=None), paper(4, None), paper(5, "q", "S", year=0),
    ], PAPER)
    got = {r["c"]: r for r in fusion.fuse(df.withColumn("c", F.col("id")), "c").collect()}
    assert (got["p"]["title"], got["p"]["year"], got["p"]["venue"], got["p"]["citations"], got["p"]["n_records"]) == ("T one", 2001, "J. Neurosci.", 9, 3)
    assert got["q"]["year"] == 0 and len(got) == 2
    assert rows(fusion.united_lists(df, "id", "keywords")) == [("p", "x", "X"), ("p", "y", "y")]
    assert rows(fusion.field_conflicts(df, "id")) == [("p", 2, "title")]
    assert fusion.fuse(df.limit(0).withColumn("c", F.col("id")), "c").count() == 0


def test_dedup_clusters(spark):
    long = "a study of very many things in a long title about one"
    df = spark.createDataFrame([
        paper(1, title=long, doi="10.1/a"), paper(2, title=long + " b", doi="10.1/A"), paper(3, title=long, doi="10.1/b"), paper(4, title=long, names=["X Y"]), paper(5, title=long, names=["X Y"], year=1990),
        paper(6, title="other"), paper(7, title="", year=None), paper(8, title="", year=None),
    ], PAPER)
    got = dict(rows(fusion.dedup_clusters(df)))
    assert got[1] == got[2] and got[4] == 1 and got[3] == 1  # through the record without identifiers
    assert got[5] == 5 and got[6] == 6 and got[7] == got[8] == 7
    assert fusion.dedup_clusters(df.limit(0)).count() == 0


def test_prefix_filter_finds_all_pairs(spark):
    import random

    rng = random.Random(3)
    titles = sorted({" ".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(120)})
    sets = {t: sorted(set(t.split())) for t in titles}
    want = {(a, b) for a in titles for b in titles if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.75}
    got = fusion.similar_titles(spark.createDataFrame(list(sets.items()), "title string, words array<string>"))
    assert {tuple(r) for r in got.collect()} == want


def test_dedup_is_as_brute_force(spark):
    import random

    rng = random.Random(8)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    data = []
    for i in range(60):
        words = base.split()
        if rng.random() < 0.4:
            words[rng.randrange(10)] = rng.choice(["x", "yy", "betas"])
        data.append(paper(i, title=" ".join(words), names=rng.choice([["A B"], ["A B", "C D"], []]), year=rng.choice([None, 2000, 2001, 2003]), doi=rng.choice([None, None, "10.1/a", "10.1/b"]), arxiv=rng.choice([None, None, None, "2501.00001", "2501.00002"]), kind=rng.choice([None, "book", "journal"])))
    df = spark.createDataFrame(data, PAPER)
    f = fusion.match_features(df)
    x, y = f.select(F.struct(*f.columns).alias("x")), f.select(F.struct(*f.columns).alias("y"))
    pairs = x.join(y, F.col("x.ord") < F.col("y.ord"))
    hit = pairs.where(fusion.matches() | (F.col("x.doi") == F.col("y.doi")) | (F.col("x.arxiv") == F.col("y.arxiv"))).where((text.jaccard(F.col("x.words"), F.col("y.words")) >= 0.75) | (F.col("x.doi") == F.col("y.doi")) | (F.col("x.arxiv") == F.col("y.arxiv")))
    parent = {i: i for i in range(60)}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in hit.select("x.ord", "y.ord").collect():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert dict(rows(fusion.dedup_clusters(df))) == {i: find(i) for i in parent}


def test_arxiv_against_doi_needs_no_words_in_common(spark):
    title, typed = "bioinformatics sequencing pipelines", "bioinformatlcs sequencing pipelines"
    df = spark.createDataFrame([
        paper(1, title=title, arxiv="2501.00001", year=1990), paper(2, title=typed, doi="10.1/a", year=2020), paper(3, title=typed), paper(4, title=typed.replace("g p", "gp"), doi="10.1/b", arxiv="2501.00002"),
        paper(5, title="abcdef", arxiv="2501.00003"), paper(6, title="abcdefg", doi="10.1/c"), paper(7, title="abcdexg", doi="10.1/d"),
    ], PAPER)
    # Record 3 bears no identifier: equal in title to 2, but thirty years of difference do not matter to 1 and 2 only.
    assert dict(rows(fusion.dedup_clusters(df))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    apart = spark.createDataFrame([paper(1, title=title), paper(2, title=typed, doi="10.1/a"), paper(3, title=typed[:-9] + "pipelinez", doi="10.1/b")], PAPER)
    assert dict(rows(fusion.dedup_clusters(apart))) == {1: 1, 2: 2, 3: 3}


def test_crossing_titles_are_as_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    titles = set()
    for _ in range(25):
        base = "".join(rng.choices("abcdeé ", k=rng.randint(4, 60)))
        titles.add(base)
        for _ in range(8):
            cs = list(base)
            for _ in range(rng.randint(0, max(1, len(cs) // 8))):
                at = rng.randrange(len(cs))
                cs[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "yz"])
            titles.add("".join(cs))
    data = [(t, rng.random() < 0.5, rng.random() < 0.5) for t in sorted(titles) if t]
    want = {(a, b) for a, xa, da in data for b, xb, db in data if a < b and (xa and db or da and xb) and SequenceMatcher(None, a, b).ratio() >= 0.92}
    got = [tuple(r) for r in fusion.crossing_titles(spark.createDataFrame(data, "title string, arxiv boolean, doi boolean")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_quality(spark):
    now = datetime(2025, 6, 30, tzinfo=timezone.utc)
    df = spark.createDataFrame([paper(1, title=" ", year=1700, doi="bad", citations=-1, conf=None), paper(2, names=["A"], doi="10.1234/x", url="https://a.example"), paper(3, conf=float("nan"))], PAPER)
    got = df.select(quality.paper_errors(now)).collect()
    assert got[0][0] == ["title", "year", "doi", "citations", "evidence"] and got[1][0] == [] and got[2][0] == ["evidence.confidence"]
    c = df.select(quality.composite_confidence(F.transform(quality.valid_evidence("evidence_list"), lambda e: e["source"]))).collect()
    assert [x[0] for x in c] == [None, 0.95, None]
    kinds = dict(df.dtypes)
    conf = [r[0] for r in df.select(quality.record_confidence(now, kinds)).collect()]
    assert conf[0] == pytest.approx(0.3 * 4 / 8) and conf[1] > 0.7 * 0.8  # no evidence counts as 0
    union = quality.evidence_union(spark.createDataFrame([paper(1, "p", conf=0.1), paper(2, "p", conf=0.9)], PAPER), "id", "ord", "evidence_list", best=True)
    assert [r["confidence"] for r in union.collect()] == [0.9]


def test_identity(spark):
    df = spark.createDataFrame([paper(1, names=["Ann Bee"], doi="10.1/x", conf=None), paper(2, names=["Bee, Ann", "Cy"], arxiv="arXiv:2501.00001v2", conf=0.97, abstract="a")], PAPER)
    assert rows(identity.cross_validated(df)) == [(1, None), (2, 1.0)]
    assert [r[0] for r in df.select(identity.open_location()).collect()] == [None, "https://arxiv.org/pdf/2501.00001"]
    assert [r[0] for r in df.select(identity.locate_in_byline("authors", "ann bee")["position"]).collect()] == [1, 1]
    authors = spark.createDataFrame([(1, "A00001", "Ann Bee", ["A. Bee"], 3, None), (2, "A00002", "Ann Cee", None, None, 5), (3, "A00003", "Ann Cee", None, 1, 5)], "ord bigint, id string, name string, aliases array<string>, h_index int, citations bigint")
    assert [r["ord"] for r in identity.rank_candidates(spark.createDataFrame([("ann",), ("",), (None,)], "query string"), authors, 2).orderBy("rank").collect()] == [3, 2]
    entries = spark.createDataFrame([(1, 1, "https://a.example/a00001", "x"), (1, 2, None, "ANN BEE"), (1, 3, None, "Ann Cee"), (1, 4, "A99999", None)], "ord int, position int, author_id string, name string")
    assert rows(identity.confirmed_ids(entries, authors)) == [(1, 1, "A00001", "id"), (1, 2, "A00001", "name"), (1, 3, None, None), (1, 4, None, None)]
    assert identity.watch_list(entries.select("name"), spark.createDataFrame([("Bee Ann",), ("",)], "name string")).count() == 1


def test_enrichment_order(spark):
    chain = quality.Enrichment().register("b", 2, lambda d: d.withColumn("v", F.concat("v", F.lit("b")))).register("a", 1, lambda d: d.withColumn("v", F.concat("v", F.lit("a"))))
    assert chain(spark.createDataFrame([("",)], "v string")).collect()[0][0] == "ab"
    chain.unregister("a")
    assert chain(spark.createDataFrame([("",)], "v string")).collect()[0][0] == "b"


def test_pages(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "a")], "ord int, t string")
    assert [r[0] for r in filters.keyset_page(df, ["t", "ord"], None, 2).collect()] == [1, 3]
    assert [r[0] for r in filters.keyset_page(df, ["t", "ord"], (None, 1), 5).collect()] == [3, 4, 2]
    with pytest.raises(ValueError):
        filters.offset_page(df, ["ord"], -1, 1)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 21), (3, "C", 30)], "k int, v string, n int")
    assert rows(upserts.upsert(old, new, ["k"])) == [(1, "a", 10), (2, "B", 21), (3, "C", 30)]
    assert rows(upserts.upsert_keep(old, new, ["k"], ["n"])) == [(1, "a", 10), (2, "B", 20), (3, "C", 30)]
    assert rows(upserts.insert_ignore(old, new, ["k"], "n")) == [(1, "a", 10), (2, "b", 20), (3, "C", 30)]
    assert rows(upserts.last_wins(old.unionByName(new), ["k"], "n")) == [(1, "a", 10), (2, "B", 21), (3, "C", 30)]
    assert rows(upserts.delete_keys(old, new.select("k"), ["k"])) == [(1, "a", 10)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("a", "c", "r"), ("x", "y", "r"), (None, "a", "r")], "source string, target string, relation string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs_levels(e, start, 3)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.shortest_paths(e, start, 3).select("node", "length")) == [("a", 0), ("b", 1), ("c", 1)]
    assert graph.ego_subgraph(e, start, 1)[1].count() == 4
    assert [r["node"] for r in graph.expand_budgeted(e, start, 2, 1).orderBy("place").collect()] == ["a", "b"]
    assert graph.bfs_levels(e.limit(0), start, 2).count() == 1


def test_coauthors_and_citing(spark):
    df = spark.createDataFrame([(1, "p", [("A1", "x", 1, "U"), ("A2", "y", 2, None), (None, "z", 3, None)], 2001, 5, ["k"]), (2, "q", [("https://a.example/a1", "x", 1, None), ("A2", "y", 2, "V")], 1999, None, ["K", "l"])], "ord bigint, id string, authors array<struct<author_id:string,name:string,position:int,affiliation:string>>, year int, citations bigint, keywords array<string>")
    assert rows(edges.coauthor_pairs(edges.authorships(df))) == [("A1", "A2", 2, 1999, 2001)]
    flat = {r["author"]: r for r in citing.flatten_authors(df).collect()}
    assert flat["id:A1"]["affiliation"] == "U" and flat["id:A2"]["affiliation"] is None and flat["name:z"]["n_papers"] == 1
    assert rows(citing.author_profiles(df).select("author", "citations", "keywords")) == [("A1", 5, "k; l"), ("A2", 5, "k; l")]


def test_changes(spark):
    cols = "ord bigint, id string, title string, year int, venue string, abstract string, doi string, url string, pdf_url string, citations bigint"
    old = spark.createDataFrame([(1, "p", "T", 1, None, None, "10.1/A", None, None, 1)], cols)
    new = spark.createDataFrame([(2, "p", "T ", 1, None, None, "10.1/A", None, None, 1), (3, None, "T", 2, None, None, "10.1/a", None, None, 1), (4, "z", "T", 1, None, None, None, None, None, 1)], cols)
    assert rows(changes.detect_changes(new, old)) == [(2, "unchanged", 1, ""), (3, "updated", 1, "year,doi"), (4, "new", None, None)]


def test_changes_by_content_hash(spark):
    old = spark.createDataFrame([paper(1, "p", "T", ["A B"], citations=1), paper(2, "q", "T", ["A B"], citations=1), paper(3, None, None), paper(4, "r", "U", ["A B"])], PAPER)
    new = spark.createDataFrame([paper(5, None, "T", ["A B"], citations=2), paper(6, "z", "T", ["A B"], doi="10.1/z", citations=1), paper(7, None, "T", ["C D"]), paper(8, None, None), paper(9, "p", "U", ["A B"])], PAPER)
    assert rows(changes.detect_changes(new, old)) == [(5, "updated", 2, "citations"), (6, "updated", 2, "doi"), (7, "new", None, None), (8, "new", None, None), (9, "updated", 1, "title,citations")]


def test_author_scores(spark):
    cols = "ord bigint, name string, affiliation string, interests array<string>, coauthors array<string>, active_years array<int>, venues array<string>, orcid string, semantic_scholar_id string, openalex_id string"
    df = spark.createDataFrame([(1, "Wei Zhang", "Univ X", ["a"], [], [2000, 2005], [], None, None, None), (2, "Wei Zhang", "Univ X", ["a"], [], [2000, 2005], [], None, "s", None), (3, "W. Zhang", None, [], [], None, [], "o1", None, None), (4, "Wei Zhang", None, [], [], None, [], "o2", None, None)], cols)
    got = {(r["a_ord"], r["b_ord"]): r for r in changes.author_scores(changes.author_pairs(df)).collect()}
    assert got[1, 2]["verdict"] == "same" and got[3, 4]["total"] == 0.0
    assert changes.author_pairs(df.limit(0)).count() == 0


def test_quota(spark):
    df = spark.createDataFrame([(1, "s", T0, 5.0), (2, "s", T0, None), (3, "s", T1, 1.0)], "id int, s string, ts timestamp, c double")
    assert sorted(r["used"] for r in quota.usage(df, "s", "ts", "c", None).collect()) == [1.0, 5.0]
    assert quota.gate(df, "s", "ts", "id", 1, None).count() == 2
    assert rows(quota.breaker(df.withColumn("t", F.col("c") > 2), "s", "ts", "id", "t", None).where("denied").select("id")) == [(2,)]


def test_segments(spark):
    lines = [("d", 1, i, t, s, None, x) for i, (t, s, x) in enumerate([(0.0, 14.0, "Head"), (12.0, 10.0, "a"), (24.0, 10.0, "b"), (60.0, 10.0, "c")])] + [("d", 2, 0, 0.0, 10.0, "Bold", "H2"), ("d", 2, 1, 12.0, 10.0, None, "e")]
    df = spark.createDataFrame(lines, "doc string, page int, line int, top double, size double, font string, text string")
    got = [(r["segment"], r["heading"], r["page"], r["text"]) for r in segments.segment_lines(df).orderBy("segment").collect()]
    assert got == [(1, "Head", 1, "a b"), (2, "Head", 1, "c"), (3, "H2", 2, "e")]


def test_payloads(spark):
    work = '{"id":"https://openalex.example/W5","title":"T","publication_year":2020,"doi":"https://doi.org/10.1234/x","abstract_inverted_index":{"b":[1],"a":[0,2]},"referenced_works":["https://o.example/W1","x"]}'
    r = payloads.openalex_works(spark.createDataFrame([(work,), ("{}",), (None,)], "p string"), "p").collect()
    assert (r[0]["id"], r[0]["abstract"], r[0]["references"], r[0]["doi"]) == ("W5", "a b a", ["W1"], "10.1234/x") and r[1]["id"] is None
    item = '{"DOI":"10.1234/y","title":["Q"],"author":[{"given":"A","family":"B","affiliation":[{"name":"U"}]}],"issued":{"date-parts":[[2011,1]]}}'
    c = payloads.crossref_items(spark.createDataFrame([(item,)], "p string"), "p").collect()[0]
    assert (c["names"], c["affiliations"], c["year"]) == (["A B"], ["U"], 2011)
    e = payloads.coci_edges(spark.createDataFrame([('[{"citing":"10.1234/a","cited":"10.1234/b"},{"citing":"10.1234/a","cited":"10.1234/A"}]',)], "p string"), "p")
    assert rows(e) == [("10.1234/a", "10.1234/b")]
    atom = "<entry><id>http://arxiv.example/abs/2501.00001v2</id><title>A\n b</title><published>2025-01-02</published><author><name>N</name></author><category term='cs.DL'/></entry>"
    a = payloads.atom_entries(spark.createDataFrame([(atom,)], "p string"), "p").collect()[0]
    assert (a["arxiv_id"], a["title"], a["year"], a["venue"]) == ("2501.00001", "A b", 2025, "arXiv:cs.DL")
    o = payloads.unpaywall_locations(spark.createDataFrame([('{"doi":"10.1234/z","best_oa_location":{"url":"https://b.example"},"oa_locations":[{"url":"https://b.example"},{"url":"ftp://x"},{"url":"https://c.example"}]}',)], "p string"), "p")
    assert [x["url"] for x in o.orderBy("rank").collect()] == ["https://b.example", "https://c.example"]
    m = payloads.manifest_files(spark.createDataFrame([('{"entries":[{"url":"s3://b/data/works/updated_date=2024-01-02/part_000.gz","meta":{"content_length":5,"record_count":2}}]}',)], "p string"), "p").collect()[0]
    assert m["url"].startswith("https://b.s3.") and m["part"] == "2024-01-02"
    assert one(spark, "Phys. Rev. D, vol. 12, 34-56 (2001)", payloads.clean_journal_ref) == "Phys. Rev. D"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", ["a;b"]), (2, None, [])], "ord int, t string, l array<string>")
    sinks.export(df, str(tmp_path / "c"), "csv", excel_safe=True, order="ord")
    back = sinks.read_csv(spark, str(tmp_path / "c"), ["ord"])
    assert sorted(r["t"] or "" for r in back.collect()) == ["", "'=x"]
    sinks.export(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    with pytest.raises(ValueError):
        sinks.read_csv(spark, str(tmp_path / "c"), ["nope"])


def test_streams(spark, tmp_path):
    from quillspark.streaming.ingest import citation_stream, ingest

    df = spark.createDataFrame([("W1", "w2 ", T0), ("W1", "W2", T0), (None, "W3", T0)], "cited_id string, citing_id string, recorded_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest(citation_stream(spark, str(tmp_path / "in"), "cited_id string, citing_id string, recorded_at timestamp"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r["cited"], r["citing"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("W1", "W2")]


def test_ingest_keeps_late_citations(spark, tmp_path):
    from quillspark.streaming.ingest import citation_stream, ingest

    schema, out, ck = "cited_id string, citing_id string, recorded_at timestamp", str(tmp_path / "out"), tmp_path / "ck"

    def deliver(*data):
        spark.createDataFrame(data, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()

    def run():
        q = ingest(citation_stream(spark, str(tmp_path / "in"), schema), out, str(ck))
        assert q.awaitTermination(60)

    def stored():
        return sorted((r["cited"], r["citing"], r["recorded_at"].month) for r in spark.read.parquet(out).collect())

    deliver(("W1", "W2", T2), ("W1", "W2", T1))
    # A month behind the newest time, and a repeat of a stored pair.
    deliver(("W3", "W4", T0), ("w1", "W2", T0))
    want = [("W1", "W2", 2), ("W3", "W4", 1)]
    assert stored() == want
    # The second batch is run again, as after a crash before its commit.
    for name in ("1", ".1.crc"):
        (ck / "commits" / name).unlink(missing_ok=True)
    run()
    assert stored() == want


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; assert e._llm == ({}, {}) and 'p4_found' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


# Added: refresh, greedy names, graph snapshots, extraction, store


def test_refresh_matches_the_sequential_definition(spark):
    import random as _random

    from quillspark.operators import refresh

    rng = _random.Random(3)
    words = "rivers lakes deep cold water stone model study north south wind".split()
    rows = []
    for k in range(60):
        base = rng.randrange(18)
        title = " ".join(words[(base + j) % 11] for j in range(6 if base % 2 else 5)) + (" extra" if rng.random() < 0.2 else "")
        rows.append((k, rng.choice([None, f"W{base}"]), rng.choice([None, f"10.1000/{base}"]), rng.choice([None, f"http://x/{base}/"]), title, 2000 + base % 3, None, None, None, None, [{"name": f"N {base}"}], [], []))
    kind = "ord bigint, id string, doi string, url string, title string, year int, venue string, abstract string, pdf_url string, citations bigint, authors array<struct<name:string>>, keywords array<string>, evidence_list array<struct<source:string,confidence:double,collected_at:timestamp,raw_data:string>>"
    df = spark.createDataFrame(rows, kind)
    new, old = df.where("ord % 2 = 1"), df.where("ord % 2 = 0")
    got = {r["ord"]: r["old_ord"] for r in refresh.detect(new, old).collect()}

    def key(t):
        return " ".join(t.split())

    olds = [r for r in rows if r[0] % 2 == 0]
    taken, want = set(), {}
    owner = lambda r: r[1] or r[0]
    for n in [r for r in rows if r[0] % 2 == 1]:
        hit = None
        tests = [lambda o: n[1] and o[1] == n[1], lambda o: n[2] and o[2] == n[2], lambda o: n[3] and o[3] == n[3], lambda o: (o[4], o[10], o[5]) == (n[4], n[10], n[5])]
        for t in tests:
            same = [o for o in olds if t(o)]
            if same and owner(same[-1]) not in taken:
                hit = same[-1]
                break
        if hit is None:
            best = 0.0
            for o in olds:
                a, b = set(key(n[4]).split()), set(key(o[4]).split())
                share = len(a & b) / len(a | b)
                people = 1.0 if n[10] == o[10] else 0.0
                score = 0.9 * share + 0.1 * people if share >= 0.95 else 0.7 * share + 0.3 * people
                if owner(o) not in taken and share >= 0.8 and abs(n[5] - o[5]) <= 1 and score >= 0.85 and score > best + 1e-12:
                    best, hit = score, o
        if hit is not None:
            taken.add(owner(hit))
        want[n[0]] = hit[0] if hit else None
    assert {k: owner(rows[v]) if v is not None else None for k, v in got.items()} == {k: owner(rows[v]) if v is not None else None for k, v in want.items()}
    assert refresh.detect(new.limit(0), old).count() == 0 and {r["change"] for r in refresh.detect(new, old.limit(0)).collect()} == {"new"}
    stored, counts = refresh.applied(refresh.detect(new, old), new, old)
    assert stored.groupBy("id").count().where("count > 1").isEmpty() and sum(r["n"] for r in counts.collect()) == 30


def test_seed_clusters_follow_the_greedy_pass(spark):
    from quillspark.operators.authors import seed_clusters

    names = ["a b c d e", "a b c d", "a b c", "x y", "y x", None, "", "a b c d e f", "q", "b c d e f a"]
    got = {r["ord"]: r["cluster"] for r in seed_clusters(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord bigint, name string")).collect()}
    want, left = {}, list(range(len(names)))
    while left:
        seed, *rest = left
        a = set((names[seed] or "").split())
        members = [o for o in rest if (names[o] or "") == (names[seed] or "") or (a or (names[o] or "").split()) and len(a & set((names[o] or "").split())) / len(a | set((names[o] or "").split())) >= 0.8]
        for m in [seed, *members]:
            want[m] = seed
        left = [x for x in rest if x not in members]
    assert got == want


def test_author_clusters(spark):
    from quillspark.operators.authors import author_clusters, disambiguated

    def author(i, name, orcid=None, affiliation="Univ of Alba", interests=("rivers",), years=(2000, 2010), co=("c1",), venues=("v",)):
        return (i, f"id{i}", name, orcid, None, None, affiliation, None, None, 1, 2, list(interests), list(co), list(venues), list(years), [], "auto", [])

    kind = "ord bigint, id string, name string, orcid string, semantic_scholar_id string, openalex_id string, affiliation string, email string, homepage string, h_index int, citations bigint, interests array<string>, coauthors array<string>, venues array<string>, active_years array<int>, aliases array<string>, disambiguation_status string, evidence_list array<struct<source:string,confidence:double,collected_at:timestamp,raw_data:string>>"
    rows = [author(1, "Ann Bo"), author(2, "Ann Bo"), author(3, "Bo Ann"), author(4, "Ann Bo", affiliation="Other Place", interests=("stars",), co=(), venues=(), years=()), author(5, "Zed Yon"), author(6, "Q R", orcid="0000-0001-0000-0001"), author(7, "Someone Else", orcid="0000-0001-0000-0001")]
    df = spark.createDataFrame(rows, kind)
    got = {r["ord"]: r["cluster"] for r in author_clusters(df).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == 5 and got[6] == got[7] == 6 and got[4] != got[5]
    assert {r["cluster"]: r["n_records"] for r in disambiguated(df).collect()}[6] == 2
    assert author_clusters(df.limit(0)).count() == 0


def test_graph_snapshot_is_checked(spark, tmp_path):
    from quillspark.operators import knowledge

    nodes = spark.createDataFrame([("a", "paper", "A"), ("b", "paper", None)], "node string, kind string, title string")
    edges_ = spark.createDataFrame([("a", "b", "references")], "source string, target string, relation string")
    path = str(tmp_path / "g")
    knowledge.Graph(nodes, edges_).save(path)
    back = knowledge.Graph.load(spark, path)
    assert back.nodes.count() == 2 and back.path("a", "b") == ["a", "b"] and back.path("b", "a") == []
    for bad_nodes, bad_edges in ((nodes.limit(1), edges_), (nodes.unionByName(nodes), edges_), (nodes, edges_.unionByName(edges_))):
        knowledge.Graph(bad_nodes, bad_edges).save(path)
        with pytest.raises(ValueError, match="graph snapshot"):
            knowledge.Graph.load(spark, path)
    with pytest.raises(ValueError, match="unknown relations"):
        knowledge.relations(["likes"])


def test_selectors():
    from quillspark.operators.extraction import Rule, Spec, evaluate

    page = "<div id='x' class='a b'><p>One <b>two</b></p><p data-k='v'>Three</p><br></div><p>Out</p>"
    spec = Spec("s", {"first": Rule("#x p"), "all": Rule("div.a.b p", many=True), "attr": Rule("p[data-k]", "data-k"), "none": Rule("span", default="-"), "one": Rule("[data-k=v]")})
    assert evaluate(page, spec) == {"first": ["One two"], "all": ["One two", "Three"], "attr": ["v"], "none": ["-"], "one": ["Three"]}
    assert evaluate("", spec)["none"] == ["-"] and evaluate("<p", spec)["first"] == []


def test_one_hot_key_is_spread(spark, monkeypatch):
    from quillspark import session
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 100 < 98, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    few = spark.createDataFrame([("hot", 1), ("99", 2)], "k string, v int")
    got = session.lookup(rows, few, "k")
    assert got.where("v = 1").count() == 58_800 and got.where("v = 2").count() == 1 and got.count() == 60_000
    monkeypatch.setattr(session, "BLOCK_PAIRS", 10_000)
    left, right = rows.select("ord", "k"), rows.where("ord < 500").select(F.col("ord").alias("o"), "k")
    assert session.block_join(left, right, "k", "ord").count() == left.join(right, "k").count()


def test_capped_depth(spark):
    from pyspark.sql import functions as F

    from quillspark.operators.store import TRUNCATED, capped_depth

    deep, flat, quoted = "[" * 5 + "]" * 5, "[[]]", '{"a": "[[[[[[[["}'
    df = spark.createDataFrame([(deep,), (flat,), (quoted,), (None,)], "t string")
    assert [r[0] for r in df.select(capped_depth(F.col("t"), 4)).collect()] == [TRUNCATED, flat, quoted, None]


def test_similar_titles_meet_by_two_words(spark, monkeypatch):
    import random as _random
    from itertools import combinations

    from quillspark.operators import fusion

    rng = _random.Random(7)
    sets = {" ".join(rng.sample([f"w{i}" for i in range(40)], rng.choice([7, 8, 8, 8, 9]))) for _ in range(500)} | {"a", "a a", "b a", "a b"}
    for t in sorted(sets)[:60]:
        w = t.split()
        sets |= {" ".join(reversed(w)), " ".join([*w[1:], "x"]), " ".join([*w, "y", "z"])}
    titles = sorted(sets)
    df = spark.createDataFrame([(t, sorted(set(t.split()))) for t in titles], "title string, words array<string>")
    met, join = [], fusion.block_join

    def counted(left, right, key, by):
        pairs = join(left, right, key, by)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(fusion, "block_join", counted)
    near = lambda s, t, share: len(set(s.split()) & set(t.split())) / len(set(s.split()) | set(t.split())) >= share
    for share in (0.75, 0.8):
        got = sorted((r["t1"], r["t2"]) for r in fusion.similar_titles(df, share).collect())
        assert got == sorted(p for p in combinations(titles, 2) if near(*p, share))
    assert max(met) < len(titles) ** 2 / 8


def test_any_number_of_records_want_the_same_owners(spark):
    from quillspark.operators import refresh

    choices = [(2 * n + 1, 2 * o, f"row:{2 * o}", (4, -0.9)) for n in range(130) for o in range(125)] + [(1001, 0, "row:0", (0, 0.0)), (1001, 900, "row:900", (4, -0.9))]
    df = spark.createDataFrame(choices, "n bigint, o bigint, owner string, rank struct<tier:int,less:double>")
    got = {r["n"]: r["o"] for r in refresh.assigned(df).collect()}
    assert got == {2 * n + 1: 2 * n for n in range(125)} | {1001: 900}


def test_names_meet_queries_by_their_rarest_key(spark):
    from quillspark.operators import store

    names = [["Ana Maria Li"], ["Li", None], ["Maria Ana", "Ana"], None, [], ["xAna Marias"], ["É. Çelik", "Ana Li"]]
    kind = "ord bigint, authors array<struct<name:string>>"
    papers = spark.createDataFrame([(i, None if n is None else [(x,) for x in n]) for i, n in enumerate(names)], kind)
    asked = spark.createDataFrame([("ana maria",), ("li",), ("é. çelik",), ("nobody ana",), ("",), ("a",)], "query string")
    tokens = {("ana maria", 0), ("ana maria", 2), ("li", 0), ("li", 1), ("li", 6), ("é. çelik", 6)}
    assert set(map(tuple, store.by_tokens(papers, asked).collect())) == tokens
    assert sorted(map(tuple, store.by_name(papers, asked).collect())) == sorted(tokens | {("ana maria", 5)})


def test_pairs_that_names_cannot_save_are_not_compared_by_name(spark, monkeypatch):
    kind = "ord bigint, name string, affiliation string, interests array<string>, coauthors array<string>, active_years array<int>, venues array<string>, orcid string, semantic_scholar_id string, openalex_id string"
    full, far = ["U One", ["ai"], ["x"], [2000], ["v"]], ["V Two", ["law"], ["y"], [1990], ["w"]]
    authors = [(1, "Ana Li", *full, "o1", None, None), (2, "Ana Li", *full, None, None, None), (3, "Ana Li", *far, None, None, None), (4, "A Li", *far, "o1", None, None), (5, "Ana Li", *full, "o2", None, None)]
    pairs = changes.author_pairs(spark.createDataFrame(authors, kind)).localCheckpoint()
    whole = {tuple(r) for r in changes.author_scores(pairs).collect()}
    some = {tuple(r) for r in changes.author_scores(pairs, changes.AMBIGUOUS).collect()}
    assert some <= whole and {r for r in whole if r[2] >= changes.AMBIGUOUS} <= some and len(some) < len(whole)


def test_a_chain_of_displaced_records_costs_no_rounds(spark):
    from quillspark.operators import refresh

    # Each new record has the id of a stored one and the title of the next; the first has no id, so each takes the next one's place.
    kind = "ord bigint, id string, doi string, url string, title string, year int, venue string, abstract string, pdf_url string, citations bigint, authors array<struct<name:string>>"
    row = lambda k, i, t, year: (k, i, None, None, " ".join(f"{w}{t}" for w in ("river", "lake", "deep", "cold", "stone")), year, None, None, None, None, [(f"N {t}",)])
    links = 6
    old = spark.createDataFrame([row(2 * k, f"W{k}", k, 2000) for k in range(links)], kind)
    new = spark.createDataFrame([row(2 * k + 1, f"W{k - 1}" if k else None, k, 2001) for k in range(links + 1)], kind)
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {r["ord"]: r["old_ord"] for r in refresh.detect(new, old).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {2 * k + 1: 2 * k if k < links else None for k in range(links + 1)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 200


def test_the_last_of_several_new_records_with_an_id_stays(spark):
    from quillspark.operators import refresh

    kind = "ord bigint, id string, title string, year int, venue string, abstract string, doi string, url string, pdf_url string, citations bigint, keywords array<string>, evidence_list array<struct<source:string,confidence:double,collected_at:timestamp,raw_data:string>>"
    row = lambda k, i: (k, i, f"Title {k}", 2000, None, None, None, None, None, None, [], [])
    new = spark.createDataFrame([row(k, f"W{k % 20}") for k in range(200, 0, -1)], kind).repartition(7, "title")
    changes_ = new.select("ord", F.lit("new").alias("change"), F.lit(None).cast("bigint").alias("old_ord"), F.lit(None).cast("string").alias("changed"))
    stored, _ = refresh.applied(changes_, new, new.limit(0))
    assert {r["id"]: r["title"] for r in stored.collect()} == {f"W{k % 20}": f"Title {k}" for k in range(181, 201)}
