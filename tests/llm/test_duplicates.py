import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logaudit.llm import common, line_dedup, passage_dedup, simhash


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2050)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    root = groups(3000, edges)
    least = {}
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        least[root[x]] = min(least.get(root[x], x), x)
    assert got == {x: least[root[x]] for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("bound", [2048, 300])
def test_simhash_classes_equal_all_pairs(spark, bound):
    rng = np.random.default_rng(0)
    fps = set()
    for base in [int(x) for x in rng.integers(0, 1 << 63, 20, dtype=np.uint64)]:
        for _ in range(30):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(k)
            fps.add(x)
    while len(fps) < 1500:  # a ball that outgrows a small bound
        x = base
        for k in [*rng.integers(0, 12, 6), *rng.integers(0, 64, 2)]:
            x ^= 1 << int(k)
        fps.add(x)
    a = np.array(sorted(fps), dtype=np.uint64)
    links = [(i, j) for i in range(len(a)) for j in (np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1).tolist()]
    root, least = groups(len(a), links), {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(a)), "fp": a.view(np.int64)}))
    got = df.join(simhash.classes(df, bound=bound), "fp").toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == {i: least[r] for i, r in enumerate(root)}


def test_simhash_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (5, "one two three four", "d"), (4, "ONE two\tthree four", "e"), (4, "ONE two\tthree four", "e"), (None, "One two three four", "f"), (9, "x " * 100_000, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(i, "0" * 16, 1) for i in (1, 2, 3)} <= got
    assert {c for i, _, c in got if i in (4, 5, None)} == {4}
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_each_component(spark):
    rnd = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, d), (5, e), (7, e.upper()), (None, e), (8, c.title())]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == sorted([(0, a), (0, b), (8, c), (5, d), (5, e)])


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_line_dedup_equals_all_pairs(spark):
    rnd = random.Random(5)
    docs = [(i, "\n".join(" ".join(rnd.choice("abc") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(0, 4)))) for i in range(50)]
    docs += [(7, docs[7][1]), (None, None), (100, ""), (3, "A b c a b\n A  b C a b a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rid = {(r.doc_id, r.text): r.rid for r in line_dedup.with_rid(df, "doc_id", "text").collect()}
    places, words = [], []
    for d, t in rid:
        for i, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) >= 5:
                places.append((d is not None, d or 0, rid[d, t], i))
                words.append(w)
    n = len(words)
    assert n > 60
    root = groups(n, [(i, j) for i in range(n) for j in range(i) if abs(len(words[i]) - len(words[j])) < 2 and distance(words[i], words[j]) <= 1])
    want = {}
    for r in set(root):
        own = sorted(places[i] for i in range(n) if root[i] == r)
        for p in own[1:]:
            want.setdefault(p[2], []).append((p[3], len(own)))
    got = {r.rid: list(zip(r.lines, r.class_sizes, strict=True)) for r in line_dedup.duplicate_lines(df).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_line_dedup_rewrites_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e\nshort", "k", 15), (2, "a b c d x\nmore", "l", 14), (3, None, "m", None)], "doc_id long, text string, _gone string, n_chars long")
    rows = {r.doc_id: r for r in line_dedup.deduplicated(df).collect()}
    assert [rows[i].text for i in (1, 2, 3)] == ["a b c d e\nshort", "more", None] and rows[2].n_chars == 4 and rows[2]._gone == "l"
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_line_dedup_takes_equal_short_lines(spark):
    df = spark.createDataFrame([(1, "Home\n\nAll rights reserved.\na b c d"), (2, "all  rights RESERVED.\n\nhome\na b c x"), (3, " \nHome page")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    assert rows == {1: "Home\n\nAll rights reserved.\na b c d", 2: "\na b c x", 3: " \nHome page"}


def test_bands_reach_the_recall():
    for s, r in ((0.8, 0.99), (0.8, 0.9), (0.5, 0.95)):
        b, n = passage_dedup.bands(s, r)
        assert 1 - (1 - s**n) ** b >= r


def worded(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize(("shared", "own"), [(45, 30), (60, 20)])
def test_lines_that_share_a_template_meet_their_copies(spark, shared, own):
    rnd = random.Random(12)
    head, lines = worded(rnd, shared), []
    for _ in range(600):
        line = head + worded(rnd, own)
        near = list(line)
        near[shared + 15] = "zzz"
        lines += [line, near]
    texts = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "ord long, text string")
    units = common.written(texts.mapInArrow(passage_dedup._units(*passage_dedup.bands(least=passage_dedup.ROWS)), passage_dedup._UNITS), "units")
    at = {r.h: r.ord for r in units.where(F.col("kind") == passage_dedup.LINE).collect()}
    met, some = passage_dedup.colliding_lines(units)
    given = passage_dedup.pieces(texts, some.select("ord", "start", "n"))
    found = some.join(given, ["ord", "start", "n"]).select("h", "places", "words").mapInArrow(passage_dedup._sets, passage_dedup._SETS)
    found = common.written(found, "sets")
    root, dealt = (groups(len(lines), [(at[r.a], at[r.b]) for r in passage_dedup.line_links(met, found, bound=bound).collect()]) for bound in (2048, 16))
    sets = [{tuple(line[k : k + 5]) for k in range(len(line) - 4)} for line in lines]
    brute = groups(len(lines), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    together = lambda r: {(i, i + 1) for i in range(0, len(lines), 2) if r[i] == r[i + 1]}
    assert len(together(brute)) == 600 and len(together(root)) >= 594 and len(together(dealt)) >= 594
    assert len(set(root)) >= len(set(brute)) <= len(set(dealt))


def test_least_places_equal_all_windows():
    rng = np.random.default_rng(3)
    lengths = np.array([40, 0, 24, 25, 300, 9])
    words = passage_dedup._mixed(rng.integers(0, 50, lengths.sum(), dtype=np.uint64))
    words[100:160] = words[100]
    at, h = passage_dedup.least_places(words, lengths)
    hashes, start, want, keys = passage_dedup._mixed(passage_dedup._rolled(words, 10)), 0, set(), {}
    for n in lengths.tolist():
        for p in range(start, start + n - 24):
            least = hashes[p : p + 16].min()
            want.add(int(least))
            keys.setdefault(int(least), []).append(p)
        start += n
    assert set(h.tolist()) == want and (hashes[at] == h).all() and len(at) < len(words) / 4
    for least, ps in keys.items():  # every sliding paragraph holds a place of its key
        own = at[h == least]
        assert all(((own >= p) & (own <= p + 15)).any() or (hashes[p : p + 16] == least).all() for p in ps)


def covered(r, starts, lengths):
    return {w for a, n in zip(r[starts], r[lengths], strict=True) for w in range(a, a + n)}


def test_every_passage_of_more_than_fifty_words_is_found_whole(spark):
    rnd = random.Random(6)
    passages, docs, places = [worded(rnd, 51) for _ in range(200)], [], {}
    for i in range(400):
        own = worded(rnd, rnd.randint(30, 120))
        places[i] = rnd.randint(0, len(own))
        own[places[i] : places[i]] = passages[i % 200]
        docs.append((i, " ".join(own)))
    found = {r.doc_id: r for r in passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(400):
        want = set(range(places[i], places[i] + 51))
        assert want <= covered(found[i], "starts", "lengths") and len(covered(found[i], "starts", "lengths")) < 60
        assert covered(found[i], "removed_starts", "removed_lengths") >= want if i >= 200 else not found[i].removed_starts


def test_passages_equal_brute_force_on_documents(spark):
    table = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(table).select("doc_id", "text")
    found = {r.doc_id: r for r in passage_dedup.repeated_passages(docs).collect()}
    windows = {}
    for r in docs.orderBy("doc_id").collect():
        words = (r.text or "").encode().lower().split()
        for p in range(len(words) - 49):
            windows.setdefault(tuple(words[p : p + 50]), []).append((r.doc_id, p))
    repeated, later = {}, {}
    for ps in windows.values():
        for i, p in ps if len({i for i, _ in ps}) > 1 else ():
            repeated.setdefault(i, set()).update(range(p, p + 50))
            if i != ps[0][0]:
                later.setdefault(i, set()).update(range(p, p + 50))
    for want, columns in ((repeated, ("starts", "lengths")), (later, ("removed_starts", "removed_lengths"))):
        hit = sum(len(words & covered(found[i], *columns)) for i, words in want.items() if i in found)
        assert hit >= 0.98 * sum(map(len, want.values())) > 0


def test_passages(spark):
    rnd = random.Random(2)
    words = lambda n: worded(rnd, n)
    passages, docs = [words(rnd.randint(55, 90)) for _ in range(20)], []
    for i in range(100):
        own = words(rnd.randint(30, 200))
        if i < 40:
            at = rnd.randint(0, len(own))
            own[at:at] = passages[i % 20]
        docs.append((i, " ".join(own)))
    base = words(60)
    for i in range(100, 106):
        near = list(base)
        near[i - 95] = "zzz"
        docs.append((i, "\n".join([" ".join(words(15)), " ".join(near), " ".join(words(12))])))
    docs += [(300, None), (301, ""), (302, " ".join(passages[0])), (302, " ".join(passages[0])), (None, " ".join(words(80))), (None, None)]
    long = " ".join(words(40_000))
    docs += [(303, " ".join(words(30) + words(60) * 2)), (304, long), (305, long), (306, "x " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x"))
    found = {r.doc_id: r for r in passage_dedup.repeated_passages(df).collect()}
    assert all(i in found for i in range(40)) and all(i in found for i in range(100, 106))
    assert not any(i in found for i in range(40, 100)) and 300 not in found and 301 not in found
    assert sum(found[303].lengths) == 120 and found[303].removed_lengths == [60] and sum(found[306].lengths) > 29_000
    assert found[305].removed_lengths == [40_000] and found[304].lengths == [40_000] and not found[304].removed_starts and None not in found
    assert not found[100].removed_starts and found[101].removed_starts
    assert passage_dedup.repeated_passages(df.limit(0)).count() == 0


def _mixed_passages(count: int, seed: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    """Texts with passages of two sentences, each of which stands in eight other texts too, and a copy of each passage,
    every other one with a word replaced: the texts, and the two texts of each passage with the edited place."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts, pairs = [], []
    for k in range(count):
        halves = words(30), words(30)
        both = halves[0] + halves[1]
        at = int(rng.integers(0, 60)) if k % 2 else -1
        copy = [*both[:at], "other", *both[at + 1 :]] if k % 2 else both
        group = [both, copy, *[h for h in halves for _ in range(8)]]
        order = rng.permutation(len(group))
        pairs.append((len(texts) + int(np.flatnonzero(order == 0)[0]), len(texts) + int(np.flatnonzero(order == 1)[0]), at))
        texts += [" ".join(words(20) + group[i] + words(20)) for i in order]
    return list(enumerate(texts)), pairs


def test_passages_whose_parts_stand_in_many_other_texts(spark):
    texts, pairs = _mixed_passages(200, 5)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in passage_dedup.repeated_passages(df).collect()}
    covered = lambda i, removed: sum((found[i].removed_lengths if removed else found[i].lengths)) if i in found else 0
    # An edit within the first or last ten words leaves a passage of fifty words in full.
    met = [(at, covered(a, False) >= 50 and covered(b, False) >= 50, covered(max(a, b), True) >= 50 and covered(min(a, b), True) == 0) for a, b, at in pairs]
    for edited in (False, True):
        own = [m for m in met if (m[0] >= 0) == edited]
        assert sum(m[1] and m[2] for m in own) >= 0.99 * len(own), [m for m in own if not (m[1] and m[2])]
    assert set(found) == {i for a, b, _ in pairs for i in (a, b)}


def test_words_around_places_against_a_plain_search():
    rng = np.random.default_rng(9)
    reach, size = passage_dedup.REACH, passage_dedup.LONG_SHINGLE

    def plain(x: list[int], y: list[int]) -> set[tuple[int, int, int]]:
        same = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))  # noqa: E731, B905
        n = same(x, y)
        ways = [(same(x[n + dx :], y[n + dy :]), dx, dy) for dx, dy in ((1, 1), (1, 0), (0, 1))]
        more = max(w[0] for w in ways)
        return {(n, n + more + w[1], n + more + w[2]) for w in ways if w[0] == more} if more else {(n, n, n)}

    x = rng.integers(0, 3, (400, 2 * reach + size))
    y = x.copy()
    for i in range(400):
        for at in rng.integers(0, x.shape[1], rng.integers(0, 4)):
            y[i] = (np.insert(y[i], at, 7)[:-1], np.append(np.delete(y[i], at), 8), np.where(np.arange(x.shape[1]) == at, 9, y[i]))[rng.integers(0, 3)]
    n, dx, dy = passage_dedup._beyond(x, y)
    assert all((int(n[i]), int(dx[i]), int(dy[i])) in plain(x[i].tolist(), y[i].tolist()) for i in range(400))


def test_open_places_ask_alike_in_blocks_and_dealt_anew(spark):
    texts, _ = _mixed_passages(6, 6)
    df = spark.createDataFrame([(t, i) for i, t in texts], "text string, ord long")
    units = common.written(df.select("ord", "text").mapInArrow(passage_dedup._units(*passage_dedup.bands(least=passage_dedup.ROWS)), passage_dedup._UNITS), "units")
    keys = passage_dedup.shared_keys(units)
    none = spark.createDataFrame([], "ord long, start int, n int, later boolean")
    one, other = ({tuple(r) for r in passage_dedup.missed_spans(units, keys, none, df, bound=bound).collect()} for bound in (512, 4))
    assert one and one == other


def test_words_around_open_places_are_read_once(spark, monkeypatch):
    plans = {}
    real = passage_dedup.written
    monkeypatch.setattr(passage_dedup, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, name))
    rng = random.Random(4)
    shared = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    texts = [" ".join([shared[i % 3], f"x{i}", shared[(i + 1) % 3]]) for i in range(9)]
    passage_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert plans["asked"].count("MapInArrow") == 1


def test_words_are_hashed_as_xxh64_does():
    import pyarrow as pa
    import xxhash

    words = ["", "a", "Ab", "é", "😀x", "\x00", "[Z", *("k" * n + "Q" for n in range(1, 70))]
    texts = [None, "", " ".join(words), "\n".join(words), "\r\n\t a\x0bb\x0c", " c\x1cd"]
    hashes, per_line, per_text = passage_dedup._words(pa.array(["skipped", *texts])[1:])
    lines = [[w for w in re.split(r"[\t-\r ]+", line) if w] for t in texts for line in (t or "").split("\n")]
    lowered = [w.translate({c: c + 32 for c in range(65, 91)}).encode() for line in lines for w in line]
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w, 11) for w in lowered]
    assert per_line.tolist() == [len(line) for line in lines] and per_text.tolist() == [(t or "").count("\n") + 1 for t in texts]
