"""The corpus operators against brute force, with nulls, empties, ties, repeats and odd columns."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.llm import ann, bpe, mixing, packed, quality, simhash, substring, topk, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, data, **extra):
    """Rows (doc_id, text[, source]) as documents, with columns whose names clash with internal ones."""
    full = [(d[0], d[1], "en", d[2] if len(d) > 2 else "s", len(d[1] or "")) for d in data]
    df = spark.createDataFrame(full, DOCS)
    for name in ("fp", "u", "v", "size", "_doc", "_gone", "_keys", "bucket", "keys", "score", "target", "draw", "_n_words", "_n_removed", "_kept", "_score", "_predicted", "_p", "_rejected"):
        df = df.withColumn(name, F.lit(name))
    return df


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    made = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 20, 60, 120]))]
        if made and rng.random() < 0.5:
            other = rng.choice(made)
            at = rng.randint(0, len(other))
            w = w[: len(w) // 2] + other[at : at + rng.randint(5, 40)] + w[len(w) // 2 :]
        if made and rng.random() < 0.2:
            w = list(rng.choice(made))
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
        made.append(w)
    return [rng.choice([" ", "  ", "\n", "\t"]).join(w) for w in made]


EDGE = [(1000, None), (1001, ""), (1002, " \n\t "), (None, "a b c"), (1003, "x"), (1003, "x"), (1004, "w " * 30_000)]


# 1 --------------------------------------------------------------------------


def slow_fingerprint(text, k):
    w = [x.encode() for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    import xxhash

    parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(spark):
    data = list(enumerate(some_texts()))[::-1] + EDGE
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    data += [(200 + i, " ".join("edit" if k == 7 * i else x for k, x in enumerate(base.split()))) for i in range(8)]
    got = simhash.groups(documents(spark, data)).collect()
    assert len(got) == len(data)
    fps = {d: slow_fingerprint(t, 4) for d, t in data if d is not None}
    none = {slow_fingerprint(t, 4) for d, t in data if d is None}
    values = sorted(set(fps.values()) | none)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for d, v in fps.items():
        least[find(v)] = min(d, least.get(find(v), d))
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == fps[r.doc_id] and r.component_id == least[find(fps[r.doc_id])]


def test_fingerprints_are_linked_as_by_all_pairs(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    for bits in (2, 4):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                a, b = sorted((find(a), find(b)))
                root[b] = a
        got = {r.u: r.v for r in simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()}
        assert got == {v: find(v) for v in signed if find(v) != v}


def test_a_large_class_has_few_links(spark):
    rng = random.Random(6)
    base = rng.getrandbits(63)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(63), 2)) for _ in range(3000)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash._leader_links(fps, 4).count() <= 9 * len(values)
    got = simhash.linked(fps).collect()
    assert len(got) == len(values) - 1 and {r.v for r in got} == {values[0]}


def test_simhash_dedup_and_empty(spark):
    df = documents(spark, [(1, "a b c d e f"), (2, "A b  c d e f"), (3, "other words here entirely now"), (None, "a b c d e f")])
    assert {r.doc_id for r in simhash.dedup(df).collect()} == {1, 3, None}
    assert simhash.dedup(df).columns == df.columns
    assert simhash.groups(df.where("false")).count() == 0


def test_similar_groups(spark):
    rng = random.Random(9)
    data, truth = [], {}
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for k in range(4):
            w = list(base)
            for at in rng.sample(range(300), 2 * k):
                w[at] = f"x{rng.randrange(3000)}"
            data.append((10 * g + k, " ".join(w)))
            truth[10 * g + k] = 10 * g
    data += [(5000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(100))) for i in range(60)] + [(7000, None), (7001, ""), (None, data[0][1]), (0, data[0][1])]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, data)).collect()}
    found = sum(got[d] == g for d, g in truth.items())
    assert found >= 0.95 * len(truth)
    assert all(got[5000 + i] == 5000 + i for i in range(60)) and got[7001] == 7000
    kept = [r.doc_id for r in simhash.similar_dedup(documents(spark, data)).collect()]
    assert kept.count(0) == 2 and None in kept and len([d for d in kept if d in truth]) == len({got[d] for d in truth}) + 1
    assert simhash.similar_dedup(documents(spark, data).where("false")).count() == 0


def test_similar_pairs_are_all_found_and_no_other(spark):
    rng = random.Random(12)
    data = []
    for g in range(150):
        # word edits five apart take five shingles each
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        edits = rng.choice([5, 6, 6, 7])
        other = [f"x{g}" if i % 40 == 20 and i // 40 < edits else w for i, w in enumerate(base)]
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    line = " ".join(f"l{i}" for i in range(60))
    data += [(1000 + i, line + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20])))) for i in range(40)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in data}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    linked = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            linked += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, data)).collect()}
    assert linked > 100 and got == {d: find(d) for d in sets}


def test_fingerprint_links(spark):
    line = " ".join(f"w{i}" for i in range(100))
    near = [line.replace("w50", f"e{i}") for i in range(4)]
    data = [(10 + i, t) for i, t in enumerate(near)] + [(20, "b " * 50), (21, "some other words that are nothing like them")]
    # from the first: one bit of its first segment and seven others; nine bits; eight, but no segment with less than two
    bits = {10: 0, 11: 1 | 0b1111 << 21 | 0b111 << 42, 12: 3 << 20 | 0b1111 << 30 | 0b111 << 50, 13: 3 << 5 | 0b111 << 30 | 0b111 << 55}
    fps = bits | {20: 1 << 62, 21: 1 << 62}
    nodes = spark.createDataFrame([(n, f, [100 * n + k for k in range(8)]) for n, f in fps.items()], "node long, fp long, bands array<long>")
    assert [p for p in itertools.combinations(bits, 2) if _meet(bits, *p)] == [(10, 11)]
    got = {r.u: r.v for r in simhash.fingerprint_links(nodes, documents(spark, data), 5).collect()}
    assert got == {11: 10}  # 20 and 21 have one fingerprint, but not similar texts


def _meet(bits, a, b):
    x = bits[a] ^ bits[b]
    return x.bit_count() <= 8 and any((x >> low & ((1 << width) - 1)).bit_count() <= 1 for low, width in simhash.SEGMENTS)


def test_similar_groups_meet_by_fingerprints(spark, monkeypatch):
    """Near copies meet as variants of SimHash fingerprints and are joined by it, before anything else is looked for."""
    rng = random.Random(21)
    data = []
    for g in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:-1], "last"]))]
    seen, across = set(), simhash._links_across
    monkeypatch.setattr(simhash, "_links_across", lambda classes, *rest: seen.update(r.fp & (2**64 - 1) for r in classes.collect()) or across(classes, *rest))
    joined, partnered = [], simhash._partnered
    monkeypatch.setattr(simhash, "_partnered", lambda placed, least: joined.extend(placed.where("node <> comp").collect()) or partnered(placed, least))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, data)).collect()}
    fps = {d: slow_fingerprint(t, 5) for d, t in data}
    assert seen == set(fps.values()) and got == {d: d - d % 2 for d in fps}
    assert {r.node for r in joined} >= {d for d in fps if d % 2 and _meet(fps, d, d - 1)} and len(joined) > 20


# 2 --------------------------------------------------------------------------


def slow_removal(data, k):
    first = {}
    for d, t in data:
        if d is None:
            continue
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t in data:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,chunk", [(13, 800_000), (13, 50), (5, 400)])
def test_substring(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)  # for the closures that are made here
    data = list(enumerate(some_texts(7, 80)))[::-1] + EDGE + [(2000, "w " * 30_000)]
    got = substring.dedup(documents(spark, data), window).select("doc_id", "_n_words", "_n_removed", "_kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_removal(data, window)


def test_a_repeated_id_is_no_copy_unless_all_its_rows_are(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(1, a), (5, a), (5, b), (6, a), (6, a), (7, c), (7, c), (8, b + " " + c)]
    got = substring.dedup(documents(spark, data)).select("doc_id", "_n_words", "_n_removed", "_kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_removal(data, 13)


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_substring_does_not_depend_on_partitions(spark, partitions):
    data = list(enumerate(some_texts(7, 80)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = substring.dedup(documents(spark, data)).select("doc_id", "_n_words", "_n_removed", "_kept").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=repr) == slow_removal(data, 13)


def test_substring_removed_keeps_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = documents(spark, [(1, long), (2, long), (3, f"own  text {long}"), (4, None)])
    out = {r.doc_id: r for r in substring.removed(df).collect()}
    assert substring.removed(df).columns == df.columns and sorted(out) == [1, 3, 4]
    assert out[3].text == "own text" and out[3].n_chars == 8 and out[1].text == long
    assert substring.dedup(df.where("false")).count() == 0


def test_substring_tells_windows_apart(spark):
    made = [f"w{i}".encode() for i in range(1_500_000)]
    hashes = substring.rolling(substring.word_hashes(made), 13)
    keys = substring.full_key(hashes, packed.BUCKETS_EACH * 4)  # the session's shuffle partitions
    order = np.argsort(keys)
    same = np.flatnonzero((keys[order][1:] == keys[order][:-1]) & (hashes[order][1:] != hashes[order][:-1]))
    assert len(same)
    data = []
    for n, at in enumerate(same):
        for k, i in enumerate(order[[at, at + 1]]):
            window = [w.decode() for w in made[i : i + 13]]
            # the first block occurs before, so that the window is looked at in the second round
            data += [(4 * n + 2 * k, " ".join(window[:7])), (4 * n + 2 * k + 1, " ".join(window))]
    assert all(r._n_removed == 0 for r in substring.dedup(documents(spark, data)).collect())


# 3 --------------------------------------------------------------------------


def slow_targets(sizes, cap):
    """``sizes``: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(2)
    data = [(i, " ".join("w" * rng.randint(0, 50)), rng.choice(["a", "b", "b", "b", "é", "Z", None, "tiny"] if i > 4 else ["tiny"])) for i in range(300)]
    data += [(7, "again x", "b"), (None, "no id", "b"), (900, None, "a"), (901, "", "hollow")]
    df = documents(spark, data)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and len(got) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets = slow_targets(sizes, 3)
    by_total = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_total.setdefault((r.source_size, round(r.target, 6)), 0)
        by_total[r.source_size, round(r.target, 6)] += r.taken
    assert {k for k in by_total} == {(sizes[s], round(targets[s], 6)) for s in sizes}
    for (_, target), taken in by_total.items():
        assert abs(taken - target) <= 1
    assert abs(sum(r.taken for r in got) - sum(sizes.values())) <= len(sizes)


def test_mixed_rows(spark):
    df = documents(spark, [(i, "a b c", "big") for i in range(30)] + [(100, "x y z", "small")])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts[100] == 3 and max(counts.values()) == 3
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 2


# 4 and 6 ----------------------------------------------------------------------


def labelled(spark, n=900):
    rng = random.Random(11)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    data, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 6 == 0, i % 7 == 0
        if bad:
            w = [f"{x}$$$" if k % 2 else x.upper() + "!!" for k, x in enumerate(w)]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vilmo", "vilmork", "grubscha"])
        data.append((i, " ".join(w)))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not bad), int(toxic)))
    df = documents(spark, data + [(5000, None), (5001, ""), (None, "x"), (1, data[1][1]), (5002, "long " * 50_000)])
    marks = spark.createDataFrame(labels + [(None, 1, 0), (labels[0][0], None, None), labels[1]], "doc_id long, quality int, toxic int")
    return df, marks, {i: (int(i % 6 != 0), int(i % 7 == 0)) for i in range(n)}


def test_quality(spark):
    df, labels, truth = labelled(spark)
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    model = quality.fit(df, labels.where(~held))
    got = quality.score(df, model).select("doc_id", "_score", "_predicted").collect()
    assert len(got) == df.count() and all(0 <= r._score <= 1 and r._predicted == int(r._score >= 0.3) for r in got)
    unseen = [r for r in got if r.doc_id in truth and r.doc_id % 5 == 0]
    assert sum(r._predicted == truth[r.doc_id][0] for r in unseen) / len(unseen) > 0.97
    assert quality.fit(df, labels.where("false")) is None
    assert quality.score(df, None).where("_score = 0.5 AND _predicted = 1").count() == len(got)
    assert quality.score(df.where("false"), model).count() == 0


def test_toxicity(spark):
    df, labels, truth = labelled(spark)
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    categories = {"disruptive": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.fit(df, labels.where(~held), categories)
    scored = toxicity.score(df, chain)
    got = scored.select("doc_id", "_p", "_rejected").collect()
    assert len(got) == df.count() and all(len(r._p) == 2 for r in got)
    unseen = [r for r in got if r.doc_id in truth and r.doc_id % 5 == 0]
    assert sum(int(r._rejected) == truth[r.doc_id][1] for r in unseen) / len(unseen) > 0.97
    assert sum((r._p[0] > 0.5) == (not truth[r.doc_id][0]) for r in unseen) / len(unseen) > 0.97
    # the later model has a weight for the earlier category
    assert chain.models[0].dense.shape == (0,) and chain.models[1].dense.shape == (1,)
    nothing = toxicity.fit(df, labels.where("false"), categories)
    assert toxicity.score(df, nothing).where("_rejected").count() == 0


# 5 --------------------------------------------------------------------------

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    given = ["http://Example.COM/en/7x?q#f", "https://a.example.com/en/8", "http://b.net/de/8", "http://example.net/de/80", "ftp://x.org/es/", "http://org/es", None, "", "no scheme", "://", "http://É.com/en/", "a://b://c/d", "http://h?x/y", "http://notcom/en/"]
    data = [(i, u, "x") for i, u in enumerate(given)] + [(1000 + i, f"http://spam{i % 3}.example.info/win/{i}?promo={i}" if i % 2 else f"http://site.example.edu/doc/{i}", "x") for i in range(400)] + [(None, "http://a.net/x", "x"), (1, "http://a.net/x", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, anchor string")
    labels = spark.createDataFrame([(1000 + i, 1 - i % 2, 0) for i in range(300)] + [(None, 0, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels, RULES, F.col("quality") == 0).collect()
    assert len(got) == len(data)
    for r in got:
        if r.page_id is not None and r.page_id < len(given) and r.page_id != 1:
            host, path = slow_url(given[r.page_id])
            assert (r.host, r.path) == (host, path)
            fits = [x for x in RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
            best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
            assert r.rule == (best[1] + best[2] if best else None) and (not best or r.verdict == best[0])
        elif r.page_id is not None and r.page_id >= 1000:
            assert r.verdict == ("block" if r.page_id % 2 else "allow")
    plain = urls.judge(pages, labels.where("false"), RULES, F.col("quality") == 0)
    assert plain.where("page_id >= 1000 AND verdict = 'block'").count() == 0
    assert urls.judge(pages.where("false"), labels, RULES, F.col("quality") == 0).count() == 0


def test_mined_rules_are_those_of_all_combinations(spark):
    rng = random.Random(21)
    baskets = []
    for _ in range(160):
        t = sorted({f"t{min(int(rng.expovariate(0.4)), 9)}" for _ in range(rng.randint(1, 6))})
        baskets.append((t, rng.random() < (0.9 if {"t1", "t3"} <= set(t) else 0.25)))
    n, bad = len(baskets), sum(b for _, b in baskets)
    expected = {}
    for size in range(1, 7):
        for rule in itertools.combinations(sorted({x for t, _ in baskets for x in t}), size):
            having = [b for t, b in baskets if set(rule) <= set(t)]
            if having and sum(having) >= 0.03 * n and sum(having) / len(having) >= max(0.5, 1.3 * bad / n):
                expected[rule] = sum(having) / len(having)
    df = spark.createDataFrame(baskets + [(["t1"], None), ([], True)], "tokens array<string>, bad boolean")
    rules = urls.mine(df, 0.03, 0.5, 1.3)
    got = {tuple(sorted(r.rule)): r.confidence for r in rules.collect()}
    assert len(expected) > 5 and got == pytest.approx(expected)
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(baskets)], "page_id long, tokens array<string>")
    found = {r.page_id: r.confidence for r in urls.matches(pages, rules).collect()}
    best = {i: max([c for r, c in expected.items() if set(r) <= set(t)], default=None) for i, (t, _) in enumerate(baskets)}
    assert found == pytest.approx({i: c for i, c in best.items() if c is not None})


def test_a_long_rule_blocks(spark):
    names = "abcde"
    bad = [(i, "/".join(names)) for i in range(40)]
    good = [(100 + 60 * k + i, "/".join(n for n in names if n != left)) for k, left in enumerate(names) for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://site.info/{p.replace('/', 'x/')}x") for i, p in bad + good], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in bad + good], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels, RULES, F.col("quality") == 0).collect()
    assert len(got) == 340 and all(r.verdict == ("block" if r.page_id < 100 else "allow") for r in got)


# 7 and 8 ----------------------------------------------------------------------


def vectors(spark, n=400, d=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32)
    x[50:60] = x[40]
    data = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    data += [(n, None, 0), (n + 1, [float("nan")] * d, 0), (n + 2, [None] * d, 0), (n + 3, [float("inf")] * d, 0), (n + 4, [0.0] * d, 0), (None, data[0][1], 0), data[7], data[20]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("rb", F.lit(1)).withColumn("score", F.lit(1))
    return df, data


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 150)
    monkeypatch.setattr(topk, "QUERIES", 7)
    df, data = vectors(spark)
    rows = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = {}
    for r in topk.top_k(df, k=15, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    seen = {i: v for i, v in rows}
    for q in [i for i in seen if i % 20 == 0]:
        scores = sorted((-int(v @ seen[q]), i) for i, v in rows if i != q)[:15]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not got
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id < 3")).count() == 2


def test_lists_are_read_in_part():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 64))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = middles[rng.integers(0, 40, 6000)] + 0.01 * rng.normal(size=(6000, 64))
    rows = np.floor(64 * rows).astype(np.float32)
    queries = rows[:200]
    lists = topk.SubspaceLists(rows)
    for at in range(0, 200, 32):
        for q, (found, scores) in zip(queries[at : at + 32], lists.top(queries[at : at + 32], 20), strict=True):
            every = rows @ q
            assert np.array_equal(scores, every[found])
            assert set(np.flatnonzero(every > np.sort(every)[-20])) <= set(found.tolist())
    assert lists.read < 0.5 * lists.entries
    # with the bar of another block little is read of one that has nothing for the query
    lists = topk.SubspaceLists(rows)
    found = lists.top(-queries[:32], 20, np.full(32, 4000.0))
    assert lists.read < 0.25 * lists.entries and not any(len(f) for f, _ in found)


def test_lists_of_anything_are_exact():
    rng = np.random.default_rng(2)
    for n, d in ((300, 1), (500, 3), (2000, 64)):
        rows = np.floor(64 * rng.normal(size=(n, d)))
        lists = topk.SubspaceLists(rows)
        for q, (found, scores) in zip(rows[:40], lists.top(rows[:40], 7), strict=True):
            every = rows @ q
            assert sorted(scores)[-7:] == sorted(every)[-7:] and set(np.flatnonzero(every >= np.sort(every)[-7])) <= set(found.tolist())


def test_ann(spark):
    df, data = vectors(spark, 1500)
    rows = {i: np.array(v, dtype=np.float64) for i, v, _ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    got = {}
    for r in ann.nearest(df, k=10, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(got) == {i for i in rows if i % 50 == 0}
    for q, found in got.items():
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        for _, i, s in found:
            assert s == pytest.approx(float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), abs=1e-12)
        best = sorted((float(((rows[i] - rows[q]) ** 2).sum()), i) for i in rows if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.where("false")).count() == 0
    codebooks = ann.train(np.stack(list(rows.values()))[:800], books=4, words=32)
    x = np.stack(list(rows.values()))[:50]
    codes, norms = codebooks.encode(x, beam=4)
    sums = codebooks.words[np.arange(4), codes].sum(1)
    assert np.allclose((sums**2).sum(1), norms) and ((x - sums) ** 2).sum() < 0.5 * (x**2).sum()
    greedy, _ = codebooks.encode(x, beam=1)
    assert ((x - sums) ** 2).sum() <= ((x - codebooks.words[np.arange(4), greedy].sum(1)) ** 2).sum()


def test_ann_of_many_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1800, 16)).astype(np.float32)
    copies = rng.permutation(1800)[:600]
    x[copies] = x[copies[0]]
    order = rng.permutation(1800)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in order], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, k=10, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    queries = [int(i) for i in copies if i % 20 == 0]
    assert queries
    for q in queries:
        assert [i for _, i in sorted(got[q])] == sorted(int(i) for i in copies if i != q)[:10]


# 9 --------------------------------------------------------------------------


def test_warc(spark):
    data = [(5, "http://a/1", "same"), (3, "http://a/2\r\nX: y", "same"), (9, None, "same"), (4, "", None), (8, "u", ""), (6, "http://b", "é\r\n\r\nWARC/1.1\r\n"), (7, "http://c", "x" * 300_000), (None, "n", "same"), (None, "n", "alone"), (3, "again", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=repr)
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in data:
        raw = (h or "").encode()
        original = first.get(h or "")
        own = i == original
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else original))
    assert got == sorted(expected, key=repr)
    assert warc.archived(pages.where("false")).count() == 0


def test_warc_payloads_and_members(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://a", "one"), (3, "http://b", "two")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    read = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert bytes(read["<urn:page:1>"].payload) == b"one" and read["<urn:page:2>"].record_type == "revisit" and all(r.intact for r in read.values())
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 7\r\n\r\nA\r\n\r\nxy\r\n\r\n"
    two = gzip.compress(record % 1) + gzip.compress(record % 2)
    assert [r[0] for r in warc.parse(two)] == ["<urn:page:1>", "<urn:page:2>"]


# 10 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def odd_texts():
    rng = random.Random(1)
    made = ["", " ", "a" * 5000, "ab" * 2000, "\x1c\x1d a", "\u3000  x", "x\n\n  y", "I'm 123\uff14\uff15\uff16 ½ ñandú🙂👨‍👩‍👧", "<|endoftext|>", "\x00\x01", "aaab" * 50]
    return made + ["".join(rng.choice("abcde the\n\t\x0b\x85 éü漢字🙂1") for _ in range(200)) for _ in range(100)]


def test_bpe(spark, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    data = [(i, t) for i, t in enumerate(odd_texts())] + [(500, None), (None, "no id"), (1, "twice"), (1, "twice")]
    expected = [(i, reference.encode_ordinary(t or "")) for i, t in data]
    for spaced in (False, True):
        got = bpe.encode(documents(spark, data), path, pattern, spaced)
        assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    decoded = got.select("doc_id", bpe.decoder(got, path)("ids").alias("b")).collect()
    assert sorted(((r.doc_id, bytes(r.b).decode()) for r in decoded), key=repr) == sorted(((i, t or "") for i, t in data), key=repr)
    trip = bpe.round_trip(documents(spark, data), path, pattern, spaced=True).collect()
    digests = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), (_, x) in zip(data, expected, strict=True)]
    assert sorted(map(tuple, trip), key=repr) == sorted(digests, key=repr)
    assert bpe.encode(documents(spark, data).where("false"), path, pattern).count() == 0


@given(st.lists(st.sampled_from([*"ab'.1 \n\t\r\x85\xa0\u3000\u2003\x1c\0", "  ", "\n ", "'s", "é"]), max_size=30))
def test_words_are_cut_where_the_pattern_cuts(parts):
    import regex

    pattern = regex.compile(bpe.piece_pattern(pytest.importorskip("public_tokenizers").PATTERN))
    text = "".join(parts)
    assert "".join(bpe.words_of(text)) == text
    assert [p for w in bpe.words_of(text) for p in pattern.findall(w)] == pattern.findall(text)


def test_words_beyond_the_store(spark, vocabulary):
    path, pattern = vocabulary
    docs = documents(spark, list(enumerate(some_texts())))
    whole = sorted(map(tuple, bpe.round_trip(docs, path, pattern, True).collect()))
    for store in (0, 3):
        few = bpe.Vocabulary(docs, path, pattern, True, store)
        assert len(few.encoder().store) == store
        assert [len(b"".join(x)) // 4 for x in few.encoder().encode(t for _, t in enumerate(some_texts()))] == [sum(r[1] for r in whole)]


def test_merges_may_run_backwards():
    # "abc" has a lower rank than "ab" and "bc": a merge makes an earlier one possible
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"abab": 259}
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    for t in ("abc", "ababc", "abcabab", "aababcbc", "bcbcab"):
        assert np.frombuffer(replay.encode([t.encode()])[0], "<i4").tolist() == reference.encode_ordinary(t)
