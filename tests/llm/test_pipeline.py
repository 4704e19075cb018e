"""The pipeline's stages against brute force: each acts on what it gets, and keeps what is clean."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
from test_llm import SCHEMA, brute_groups, brute_lines, brute_match, sentence  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


def documents():
    rng = random.Random(99)
    line = lambda n=12: sentence(rng, n) + f" {rng.randrange(10**6)}."
    texts = ["\n".join(line() for _ in range(rng.randrange(3, 8))) for _ in range(80)]
    texts += [texts[3], texts[4], texts[3]]  # copies
    texts += ["\n".join([texts[5].split("\n")[0], texts[6].split("\n")[0]]), "\n".join([texts[7].split("\n")[1], line()])]  # lines of others
    words = line(200).split()
    for k in range(5):  # near copies, each one line
        own = list(words)
        own[20 * k] = "changed"
        texts.append(" ".join(own))
    texts += ["before " + ITEMS[0][1] + " " + line(), "### $$$ %%% " * 30, "", None, " \n ", "short\nshort", "LINE that is long ENOUGH\nline That is long enough"]
    return [(i, t, ("en", None)[i % 3 == 0], "s0", len(t or "")) for i, t in enumerate(texts)]


ITEMS = [(1, "an item of the benchmark that one document holds whole and word for word"), (2, None)]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    out, rows = str(tmp_path_factory.mktemp("pipeline")), documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t, *_ in rows if i % 2 == 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def brute_near(rows):
    groups = brute_groups(rows, 5)
    return [r for r in rows if groups[r[0]][1] == r[0]]


def brute_line_stage(rows):
    left, out = brute_lines(rows), []
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owner, first = {}, {}
    for i, t, *_ in sorted(rows):
        first.setdefault(t or "", i)
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), i)
    for i, t, lang, source, _ in rows:
        text = left[i][0]
        owners = {owner[key(x)] for x in (t or "").split("\n") if len(key(x)) >= 10 and owner[key(x)] != i}
        whole = len(t or "") >= 10 and first[t or ""] < i
        if text.strip(" \t\n\x0b\x0c\r") or not (whole or len(owners) == 1):
            out.append((i, text, lang, source, len(text)))
    return out


def test_run_equals_brute_force(spark, place):
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{place}/documents.parquet"), documents()
    good = [tuple(r) for r in STAGES["quality_classifier"](spark, docs, place).collect()]
    assert set(good) <= set(rows) and len(good) >= 85 and not any("###" in t or not t.strip() for _, t, *_ in good)
    kept = brute_line_stage(good)
    single = brute_near(kept)
    clean = [r for r in single if not any(x and brute_match(r[1], x) >= 0.8 for _, x in ITEMS)]
    assert len(good) > len(kept) > len(single) > len(clean)
    tokens = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    got = {r.doc_id: list(memoryview(bytes(r.ids)).cast("I")) for r in corpus_pipeline.run(spark, place).collect()}
    assert got == {r[0]: tokens.encode(r[1], add_special_tokens=False).ids for r in clean}
    assert len(set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before) == 1  # the last stage's table


def test_stages_equal_brute_force(spark, place):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("gone", "owner", "node", "held_id", "copy_of", "more")})
    run = lambda name: {tuple(r) for r in STAGES[name](spark, docs, place).select(*corpus_pipeline.COLUMNS).collect()}
    assert all(STAGES[n](spark, docs, place).columns == corpus_pipeline.COLUMNS for n in list(STAGES)[:-1])
    assert run("line_dedup") == set(brute_line_stage(rows))
    assert run("minhash_near_dedup") == set(brute_near(rows))
    assert run("benchmark_decontamination") == {r for r in rows if not any(x and brute_match(r[1], x) >= 0.8 for _, x in ITEMS)}


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, place, name):
    rows = [(None, "no id but some ordinary words in it", "en", "s0", 1), (None, None, None, None, None), (5, "twice the same row of words here", "en", "s0", 1), (5, "twice the same row of words here", "en", "s0", 1), (6, "word " * 30_000, "en", None, 1), (7, "", None, "s0", 0), (8, "İıſ 長い文 \x00 é", "xx", "s0", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = STAGES[name](spark, docs, place).collect()
    empty = STAGES[name](spark, docs.limit(0), place)
    assert empty.count() == 0
    if name == "quality_classifier":
        assert {r.doc_id for r in got} <= {None, 5, 6, 8} and sum(r.doc_id == 5 for r in got) in (0, 2)
    else:
        assert len(got) == len(rows)


def test_recall_of_the_near_duplicate_stage(spark):
    """On what two stages leave of the test tables: every document that brute force drops is dropped, and no other."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    from fleetlens.llm.common import staged

    docs, _ = staged(STAGES["line_dedup"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "lines")
    rows = [tuple(r) for r in docs.collect()]
    shingles = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders, parent = {}, {i: i for i in shingles}
    for i, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for some in holders.values() for a in some for b in some if a < b}:
        if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {i for i in parent if find(i) != i}
    got = {r[0] for r in rows} - {r.doc_id for r in STAGES["minhash_near_dedup"](spark, docs, sf).collect()}
    assert got == want and len(want) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_on_the_test_tables(spark):
    from fleetlens.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark_decontamination":
            assert not any(x in r.text for x in items for r in after.values())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(before) and all(r.n_tokens == len(r.ids) // 4 for r in last)


def test_stages_send_small_batches_to_python(spark, place):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    long = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("words "), 1000).alias("text"))
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name in ("quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"):
        spark.conf.unset(key)
        STAGES[name](spark, docs, place)
        got = long.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 5_000_000, name
    spark.conf.set(key, "1m")  # a setting of the session's own stays
    STAGES["bpe_encoding"](spark, docs, place)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
