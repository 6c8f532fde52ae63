"""The pipeline stage by stage, each on its own input, and the queries with SQL."""

import glob
import hashlib
import itertools
import math
import os
import sys

import duckdb
import pytest

import corpus_pipeline
from tarnwell.llm import bpe, queries, toxicity
from tarnwell.llm.common import saved

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import slow_removal, slow_targets, words  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def slow_toxicity(spark, docs):
    """The rows that the fitted chain keeps, scored one by one."""
    chain = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.read.parquet(f"{SF_DIR}/labels.parquet"), queries.toxic_chain(), rows=12_000)
    features = toxicity.Featurizer(chain.vocabulary)
    return [r for r in docs if chain.probabilities([features(r[1])])[0][-1] < chain.thresholds[-1]]


def slow_near_copies(spark, docs):
    """The smallest id of each group linked by 0.8 similarity of five-word shingles, from all pairs."""
    sets = {}
    for r in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets[r[0]] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [r for r in docs if find(r[0]) == r[0]]


def slow_repeats(spark, docs):
    out = []
    found = {(d, n, gone, kept) for d, n, gone, kept in slow_removal([(r[0], r[1]) for r in docs], 13)}
    by_id = {d: (n, gone, kept) for d, n, gone, kept in found}
    for r in docs:
        n, gone, kept = by_id[r[0]]
        if gone == 0:
            out.append(r)
        elif gone < n:
            out.append((r[0], kept, *r[2:4], len(kept)))
    return out


def slow_mix(spark, docs):
    size = [len(words(r[1])) for r in docs]
    sources = {}
    for r, n in zip(docs, size, strict=True):
        sources[r[3]] = sources.get(r[3], 0) + n
    targets, out = slow_targets(sources, 3), []
    for source, total in sources.items():
        whole = math.floor(targets[source] / total) if total else 0
        left = math.floor(targets[source] - whole * total + 0.5)
        draw = lambda r: hashlib.md5(f"42:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else 'null'}".encode()).hexdigest()
        for _, n, r in sorted((draw(r), n, r) for r, n in zip(docs, size, strict=True) if r[3] == source):
            extra = max(0, min(n, left))
            left -= n
            out += [r] * (whole + (extra > 0 and 2 * extra >= n))
    return out


def slow_tokens(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in docs:
        ids = reference.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


SLOW = {"toxicity": slow_toxicity, "near_duplicates": slow_near_copies, "repeated_passages": slow_repeats, "mixing": slow_mix, "byte_bpe": slow_tokens}


def test_stages(spark, tmp_path):
    """Every stage on what the one before kept, against its brute-force version."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF_DIR).write.parquet(path)
        out = spark.read.parquet(path)
        got = sorted(map(tuple, out.collect()), key=repr)
        assert got == sorted(SLOW[name](spark, [tuple(r) for r in docs.collect()]), key=repr), name
        assert out.columns == columns or name == "byte_bpe"
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()), key=repr) == got


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeats, an empty table and extra columns go through every stage."""
    from pyspark.sql import functions as F

    rows = [(i, f"word{i % 7} " * (i % 40), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, None, None, None, None), (None, "no id " * 20, "en", "s1", 1), (101, "", "en", "s1", 0), (102, "long " * 30_000, "en", "s2", 1), (103, "x", "en", "s1", 1), (103, "x", "en", "s1", 1)]
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("_keys", F.lit(1)).withColumn("u", F.lit("u")).withColumn("node", F.lit(2))
    for docs in (whole, whole.where("false")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            docs = saved(out, "odd")
            assert docs.columns == columns or name == "byte_bpe"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF_DIR)
    order = sorted(df.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(text, r)) for r in df.select(*order).collect())
    assert got == sorted(tuple(map(text, r)) for r in con.sql(queries.oracle_sql()[name]).select(*order).fetchall())
