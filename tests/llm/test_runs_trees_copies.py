"""Periodic runs, Merkle manifests and exact copies, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exactdedup, merkle, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")


# --- runs ------------------------------------------------------------------------------------------------------------


def plain_runs(words, min_length=6, min_periods=4):
    """Every period, every maximal stretch; a stretch counts if no divisor of its period is one."""
    seen = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n, out = len(ids), []
    for q in range(1, n // min_periods + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length = e - s + q
            if length >= max(min_length, min_periods * q) and not any(
                q % d == 0 and (ids[s : s + length - d] == ids[s + d : s + length]).all() for d in range(1, q)
            ):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 5)):
            words = [b"%d" % rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 60))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 7)
                words = [words[min(a + (i - a) % p, len(words) - 1)] if i > a else w for i, w in enumerate(words)]
            texts.append(words)
        for length, periods in ((6, 4), (2, 2), (9, 3)):
            assert periodic.runs_of(texts, length, periods) == [plain_runs(w, length, periods) for w in texts]
    with pytest.raises(ValueError):
        periodic.runs_of([], 6, 1)


def test_runs_of_one_word_and_of_long_periods():
    assert periodic.runs_of([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    unit = [b"%d" % i for i in range(5_000)]
    assert periodic.runs_of([[b"x", *unit * 4, b"y"]]) == [[(1, 20_000, 5_000)]]
    assert periodic.runs_of([unit * 3 + unit[:-1]]) == [[]]


def test_periodic_runs_of_the_whole_table(spark, sf):
    """The query's rows against a plain version that reads the table by itself."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert set(got) == set(rows)
    turned = found = 0
    for doc_id, text in rows.items():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            turned += 1
        runs, r = plain_runs(words), got[doc_id]
        found += len(runs)
        assert r["n_runs"] == len(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest()
    assert turned > 50 and found > 50


def test_runs_keep_all_columns_and_survive_odd_rows(spark):
    rows = [(1, "a b " * 5, 7, "x"), (1, "a b " * 5, 7, "x"), (None, None, None, None), (2, "", 1, ""), (3, "\x0b\x1cq  é", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, `a.b` string")
    found = periodic.find_runs(docs).collect()
    assert found[0] == found[1] and [tuple(r) for r in found[0]["runs"]] == [(0, 10, 2)]
    assert [r["collapsed"] for r in found] == ["a b", "a b", "", "", "\x1cq  é"]
    assert [r["a.b"] for r in found] == ["x", "x", None, "", "y"] and [len(r["runs"]) for r in found[2:]] == [0, 0, 0]
    assert periodic.find_runs(docs.limit(0)).collect() == []


# --- trees -----------------------------------------------------------------------------------------------------------


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, fanout):
    """(root, for each leaf the (before, after) of every level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, n in enumerate(at):
            low = n - n % fanout
            paths[leaf].append(("".join(level[low:n]), "".join(level[n + 1 : low + fanout])))
        at = [n // fanout for n in at]
        level = [H("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows, fanout):
    """rows: (lang, id, leaf, claim) -> {(lang, id, leaf): (subroot, root, proof, folded)}."""
    trees = defaultdict(list)
    for lang, i, leaf, claim in rows:
        trees[lang].append((i is not None, i or 0, leaf, claim))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {x: plain_tree([r[2] for r in sorted(trees[x])], fanout) for x in order}
    root, above = plain_tree([tops[x][0] for x in order], fanout)
    out = {}
    for n, lang in enumerate(order):
        for (known, i, leaf, claim), path in zip(sorted(trees[lang]), tops[lang][1]):
            whole, node = path + above[n], claim
            for before, after in whole:
                node = H(before + node + after)
            out[lang, i if known else None, leaf] = (tops[lang][0], root, H("".join(b + a for b, a in whole)), node)
    return out


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 2), (3, 1), (2, 10)])
def test_manifest_of_trees_of_all_sizes(spark, fanout, height):
    rng, rows = random.Random(fanout * 10 + height), []
    for n, lang in enumerate([None, "", "ä", "b", "ba", "z"]):
        for i in range([1, 2, 23, 9, 17, 5][n]):
            leaf = H(f"{lang}{i}")
            rows.append((lang, i if i != 4 else None, leaf, leaf if i % 3 else H("changed")))
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "lang string, id long, leaf string, claim string")
    found = merkle.manifest(given, "lang", "id", "leaf", "claim", fanout, height).collect()
    want = plain_manifest(rows, fanout)
    assert len(found) == len(rows)
    by_leaf = {(i, leaf): v for (_, i, leaf), v in want.items()}
    for r in found:
        assert (r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == by_leaf[r["id"], r["leaf"]]
        assert r["verified"] == (r["folded_root"] == r["root"])
    assert any(r["verified"] for r in found) and not all(r["verified"] for r in found)


def test_manifest_of_equal_rows_and_of_none(spark):
    leaf = H("same")
    given = spark.createDataFrame([("x", 1, leaf)] * 7, "lang string, id long, leaf string")
    found = merkle.manifest(given, "lang", "id", "leaf", block_height=1).collect()
    assert len(found) == 7 and {r["root"] for r in found} == {plain_tree([leaf] * 7, 2)[0]} and all(r["verified"] for r in found)
    assert merkle.manifest(given.limit(0), "lang", "id", "leaf").collect() == []


def test_groups_of_the_exchange_are_no_larger_than_the_fanout(spark):
    """A tree of one block more than a power: without empty blocks, one would be asked by half of all."""
    roots = spark.range(33).selectExpr("'t' AS mk_tree", "id AS mk_block", "33L AS mk_blocks", "sha2(string(id), 256) AS mk_node")
    found = {r["mk_block"]: r for r in merkle.butterfly(roots, 2).collect()}
    root, paths = plain_tree([H(str(i)) for i in range(33)], 2)
    assert {r["mk_node"] for r in found.values()} == {root}
    assert all([tuple(s) for s in found[n]["mk_path"]] == paths[n] for n in range(33))


def test_fields_of_a_leaf(spark):
    row = spark.createDataFrame([(5, None, "", "ä:1")], "a long, b string, c string, d string")
    assert row.select(merkle.leaf_digest(*map(F.col, "abcd"))).first()[0] == H("1:5-0:4:ä:1")


# --- copies ----------------------------------------------------------------------------------------------------------


def test_marked_copies(spark):
    """A group with a third of all rows, small groups, null texts and ids, rows alike in both."""
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 300}") for i in range(700)]
    rows += [(None, "n"), (None, "n"), (7, None), (8, ""), (5000, "hot"), (5000, "hot"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(9)).repartition(5)
    marked = exactdedup.mark_duplicates(docs.withColumn("d", exactdedup.text_digest(F.col("text"))), digest_col="d", counters=16)
    assert marked.columns == ["doc_id", "text", "d", "keep_id", "group_size", "kept"]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = marked.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows)
    assert all((r["keep_id"], r["group_size"]) == (last[r["text"] or ""], len(groups[r["text"] or ""])) for r in found)
    kept = Counter(r["text"] or "" for r in found if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1)) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    left = exactdedup.drop_duplicates(docs, counters=16)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exactdedup.drop_duplicates(docs.limit(0)).count() == 0


def test_frequent_digests_are_found(spark):
    rows = spark.range(20_000).selectExpr("if(id % 4 = 0, 'a', if(id % 10 = 1, 'b', string(id))) AS d").repartition(8)
    found = {r["fd_hash"] for r in exactdedup.frequent(rows, "d", 64).collect()}
    hot = {r[0] for r in spark.sql("SELECT xxhash64(x) FROM VALUES ('a'), ('b') t(x)").collect()}
    assert hot <= found and len(found) <= 64


@pytest.mark.parametrize("name", ["op13_exact_dedup"])
def test_no_python_on_the_way_of_copies(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
