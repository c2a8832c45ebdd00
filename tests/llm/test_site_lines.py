import random
from collections import defaultdict

import pytest

from topicweave.llm import site_lines as S

BODY = "the trap number {} holds a different set of words for record {} and so it is a line of its own kind {}"


def table():
    rows = []
    for i in range(40):
        mark = ["Share this (3)", "SHARE  this!", "Ｓhare this 12"][i % 3]
        body = " ".join(chr(97 + (i * 7 + k * k) % 26) * (3 + k % 4) for k in range(12))
        rows.append((i, f"u{i // 2}", f"{body}\r\n\n{mark}\n---", ["The Site", "THE  SITE"][i % 2]))
    rows += [(100 + i, f"v{i}", "Rare note", "Other") for i in range(4)] + [(104, "v3", "rare note 7", "Other"), (200, "w", None, "Other"), (201, "w", "", "Other"), (202, "w", "Share this", None), (203, None, "Share this", "The site")]
    return rows


SCHEMA = "row_id long, uid string, abstract string, source_title string"


def brute(rows):
    users, lines = defaultdict(set), []
    for row, uid, text, source in rows:
        site = "".join(source.lower().split()) if source else ""
        if text and site:
            for n, line in enumerate(text.split("\n"), 1):
                if x := S.letters_of(line):
                    users[site, x].update({uid} - {None})
                    lines.append((row, n, site, x))
    return {(r, n) for r, n, s, x in lines if len(users[s, x]) >= S.MIN_RECORDS}


def test_found_against_brute_force(spark):
    rows = table()
    got = S.SiteLines(spark.createDataFrame(rows, SCHEMA), "row_id", "uid", "abstract", "source_title").found().select("row_id", "line_no").collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows)) > 30


def test_clean_and_report(spark):
    s = S.SiteLines(spark.createDataFrame(table(), SCHEMA), "row_id", "uid", "abstract", "source_title")
    out = {r.row_id: r for r in s.without().collect()}
    assert len(out) == 49 and out[0].removed == 1 and "hare" not in out[0].abstract and out[0].abstract.endswith("\n\n---") and out[200].abstract is None and out[201].abstract == "" and out[100].removed == 0
    assert [(r.source_key, r.records) for r in s.report().collect()] == [("thesite", 20)]


def test_empty(spark):
    assert S.SiteLines(spark.createDataFrame([], SCHEMA), "row_id", "uid", "abstract", "source_title").found().count() == 0


def test_near_duplicates_are_one_cluster(spark):
    base = "This article of the {} group on 12 May 2019 is made available by the society press under an open reading licence number {} for all readers of the journal and its supplements in every country"
    rows = [(i, f"u{i}", base.format(["Alpha", "Beta", "Gamma", "Delta", "Omega", "Sigma"][i], i), "S") for i in range(6)]
    s = S.SiteLines(spark.createDataFrame(rows, SCHEMA), "row_id", "uid", "abstract", "source_title")
    assert s.found(exact=False).count() == 6 and s.found().count() == 0


@pytest.mark.parametrize("counts", [(7, 1), (4, 4), (1, 7), (3, 1, 1, 2)])
def test_counts_of_a_group_are_its_different_records(spark, counts):
    words = "this article of the society press is made available under an open reading licence for all readers of the journal and its many supplements in every country of the world by the editors".split()
    words = [f"{w}{tail}" for tail in ("", "ly", "ness") for w in words]
    rows, n = [], 0
    for v, c in enumerate(counts):
        line = " ".join(words[: 12 + v] + ["kindly"] * (v > 0) + words[12 + v :])
        for _ in range(c):
            rows += [(n, f"u{n}", line, "S"), (1000 + n, f"u{n}", line, "S")]  # a record twice counts once
            n += 1
    lines = S.SiteLines(spark.createDataFrame(rows, SCHEMA), "row_id", "uid", "abstract", "source_title")
    got = lines.found(exact=False).collect()
    assert len(got) == 2 * sum(counts) and {r.records for r in got} == {sum(counts)}
    assert all(r.removed == 1 for r in lines.without().collect())


def test_banding_against_brute_force(spark, data):
    """All pairs of kinds of one source at a similarity of 0.8: at least 0.9 of them end in one group."""
    pubs = spark.read.parquet(f"{data}/publications.parquet")
    lines = S.SiteLines(pubs, "row_id", "uid", "abstract", "source_title")
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(120):
        base = rng.choices(vocabulary, k=rng.randint(6, 60))
        for v in range(4):
            words = list(base)
            if v:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((g * 10 + v, f"u{g}-{v}", " ".join(map(spelled, words)), "S"))
    for table in (lines, S.SiteLines(spark.createDataFrame(rows, SCHEMA), "row_id", "uid", "abstract", "source_title")):
        kinds = {r.kind: set(r.shingles) for r in table.lines.filter("shingles IS NOT NULL").select("kind", "shingles").collect()}
        by = {}
        for k, x in kinds.items():
            for y in x:
                by.setdefault(y, []).append(k)
        near = {(a, b) for ks in by.values() for a in ks for b in ks if a < b and len(kinds[a] & kinds[b]) >= S.SIMILAR * len(kinds[a] | kinds[b])}
        group = {r.node: r.component for r in S.connected_components(table.links(), "a", "b").collect()}
        hit = sum(group.get(a, a) == group.get(b, b) for a, b in near)
        print(len(near), hit)
        assert (len(near) > 100 or table is lines) and hit >= 0.9 * len(near)


def spelled(word):
    return "".join(chr(97 + int(c)) for c in word[1:]) + "x"


def test_signature_estimates_similarity():
    a = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)]
    b = a[:45] + ["other"] + a[46:]
    known = S._Masked()
    texts = [S.masked_words(" ".join(x), known) for x in (a, b, list(reversed(a)))]
    sig = S.signatures(*S.shingles(texts))
    assert (sig[0] == sig[1]).mean() > 0.6 and (sig[0] == sig[2]).mean() < 0.3


@pytest.mark.parametrize("seed", range(4))
def test_all_similar_kinds_of_a_bucket_are_linked(spark, seed):
    """Forty families of sets in one bucket, more than it has leaders, some only connected by members: groups as by comparing all pairs."""
    rnd = random.Random(seed)
    sets = []
    for f in range(40):
        x = set(rnd.sample(range(f * 60, f * 60 + 60), rnd.randint(8, 30))) | set(range(10_000, 10_000 + 4 * (f % 3)))
        for _ in range(rnd.randint(1, 5)):
            sets.append(frozenset(x))
            x = x ^ {rnd.choice(sorted(x)), rnd.randrange(f * 60, f * 60 + 60)}  # each from the last: the ends of a family are unlike
    sets = {rnd.randrange(-(2**62), 2**62): x for x in dict.fromkeys(sets)}
    s = object.__new__(S.SiteLines)
    rows = [(n, 1, n, k, k, [*range(8), 1], sorted(x)) for n, (k, x) in enumerate(sets.items())]
    s.lines = spark.createDataFrame(rows, "row long, line_no int, record long, node long, kind long, bands array<long>, shingles array<int>")
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= S.SIMILAR * len(sets[a] | sets[b])]
    got = {(min(r), max(r)) for r in map(tuple, s.links().collect())}
    assert got <= set(near)

    def groups(pairs):
        top = {k: k for k in sets}
        for _ in sets:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert groups(got) == groups(near) and len(set(groups(near).values())) >= 40


def test_a_line_of_two_sources_is_a_group_of_each(spark):
    rows = [(i, f"u{i}", "Share this page", "First") for i in range(6)] + [(10 + i, f"v{i}", "Share this page", "Second") for i in range(7)]
    rows += [(20 + i, f"w{i}", "Share this page", "Third") for i in range(4)]
    s = S.SiteLines(spark.createDataFrame(rows, SCHEMA), "row_id", "uid", "abstract", "source_title")
    assert sorted((r.source_key, r.records) for r in s.report().collect()) == [("first", 6), ("second", 7)]
    assert sum(r.removed for r in s.without().collect()) == 13
