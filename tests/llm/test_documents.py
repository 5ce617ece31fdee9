"""Document operators against brute force, on small made-up tables with the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    shared = "This very line is shared by many of the documents, word for word."
    passage = " ".join(f"common{i}" for i in range(60))
    out = []
    for i in range(60):
        own = " ".join(f"w{(i * 37 + j * 11) % 997}x{i}" for j in range(5 + i * 3))
        text = own + ("\n  " + shared.upper() + "\t" if i % 3 == 0 else "") + (f"\n{passage}" if i % 4 == 0 else "")
        out.append((i, text, "en", f"s{i % 4}" if i % 9 else None))
    base = " ".join(f"b{j}" for j in range(200))
    out += [(100 + i, base, "en", "s0") for i in range(12)]
    for i in range(12):
        near = base.split()
        near[i * 7] = "changed"
        out.append((120 + i, " ".join(near), "en", "s1"))
    out += [
        (200, None, "en", "s2"), (201, "", "en", "s2"), (202, "   \n\t", None, None), (203, "one two", "en", "s3"),
        (204, "ONE TWO", "en", "s3"), (205, "É one  two three four", "en", "s3"), (206, "é one two three four", "en", "s3"),
        (207, "long " * 20_000, "en", "s9"), (207, "another text for the same id", "en", "s9"), (208, "x" * 50_000, "en", "s9"),
        (209, "twice the same row", "en", "s9"), (209, "twice the same row", "en", "s9"), (None, "no id here", "en", "s1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_by_bytes(docs, none, rows):
    from tidemark.llm.sharding import shard_documents

    got = shard_documents(docs.withColumnRenamed("n_chars", "SHARD"), n_shards=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Two texts hold most bytes: no boundary can be further off than the largest row.
    assert max(size.values()) <= sum(size.values()) / 4 + 100_001
    assert shard_documents(none).count() == 0


def test_sharding_divides_only_large_groups(spark):
    from tidemark.llm.sharding import shard_documents

    table = [(i, f"text {i} " + "y" * 90) for i in range(3000)] + [(10_000 + i, "z" * 99) for i in range(1500)]
    got = shard_documents(spark.createDataFrame(table, "doc_id long, text string"), n_shards=8, cell_rows=100).collect()
    size, texts, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        size[r["shard"]] += len(r["text"]) + 1
        texts[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    share = sum(size.values()) / 8
    assert all(abs(s - share) < 0.03 * share for s in size.values())
    assert [t for t, s in texts.items() if len(s) > 1] == ["z" * 99]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Round after round: share by weight, stop those above their cap, share the rest anew."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in stopped else unit * weight[s] for s in order}
        stopped |= over


def test_mixing(docs, none, rows):
    from pyspark.sql import functions as F

    from tidemark.llm.mixing import mix_sources

    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(dict(sizes))
    mixed = mix_sources(docs, block_words=16, shard_slots=20, chunk_rows=7)
    per_doc = mixed.groupBy("row_key", "doc_id", "size", "source_size", "target").agg(F.sum("n_words").alias("taken")).collect()
    assert Counter((r["doc_id"], r["size"]) for r in per_doc) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in per_doc)
    by_target = defaultdict(int)
    for r in per_doc:
        by_target[round(r["target"], 6)] += r["taken"]
    expected = defaultdict(float)
    for s, t in want.items():
        expected[round(t, 6)] += t
    assert by_target.keys() == expected.keys()
    assert all(abs(by_target[t] - expected[t]) <= 4 for t in expected)
    again = mix_sources(docs.repartition(3), block_words=16, shard_slots=20, chunk_rows=7)
    assert Counter(mixed.drop("row_key").collect()) == Counter(again.drop("row_key").collect())
    assert mix_sources(none).count() == 0


@pytest.mark.parametrize(("block_words", "shard_slots"), [(16, 20), (7, 300)])
def test_mixing_row_by_row(docs, rows, block_words, shard_slots):
    """The whole mix by plain lists: streams of words, blocks cut from them, slots drawn shard by shard."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm import mixing

    named = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", "source")
    table = [tuple(r) for r in docs.select("doc_id", "text", "source", named).collect()]
    by_source = defaultdict(list)
    for i, text, source, name in table:
        by_source[source].append((name, i, len(words(text))))
    order = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    sizes = {s: sum(d[2] for d in by_source[s]) for s in order}
    want = targets(sizes)
    stream, plan = {}, []
    for s in order:
        chunks = -(-len(by_source[s]) // 9)
        inside = sorted(by_source[s], key=lambda d: (d[0] % chunks, d[0], (0, 0) if d[1] is None else (1, d[1])))
        stream[s] = [(d[1], d[0], w) for d in inside for w in range(d[2])]
        plan.append(mixing.plan_slots(sizes[s], want[s], block_words, mixing.source_key(s, 17, 0)))
    slots = np.array([p[1] for p in plan])
    taken, shards = Counter(), Counter()
    n_shards = -(-int(slots.sum()) // shard_slots)
    for shard, begin, count in mixing.shard_counts(slots, shard_slots, 17, 0, n_shards):
        for n, s in enumerate(order):
            blocks, all_slots, last = plan[n]
            for slot in range(begin[n], begin[n] + count[n]):
                key = mixing.source_key_of(mixing.source_key(s, 17, 0), slot // blocks)
                block = int(mixing.permute([slot % blocks], [blocks], [key])[0])
                piece = stream[s][block * block_words : (block + 1) * block_words]
                piece = piece[:last] if slot == all_slots - 1 else piece
                shards[shard] += 1
                for i, name, _ in piece:
                    taken[i, name, shard] += 1
    assert all(n == shard_slots for shard, n in shards.items() if shard < n_shards - 1)
    made = mixing.mix_sources(docs, block_words=block_words, shard_slots=shard_slots, chunk_rows=9)
    got = Counter()
    for r in made.where("n_words > 0").groupBy("doc_id", "row_key", "shard").agg(F.sum("n_words").alias("n")).collect():
        got[r["doc_id"], r["shard"]] += r["n"]
    plain = Counter()
    for (i, _, shard), n in taken.items():
        plain[i, shard] += n
    assert got == plain
    # Any range of shards can be drawn on its own.
    part = list(mixing.shard_counts(slots, shard_slots, 17, 1, 3))
    assert [p[0] for p in part] == list(range(1, min(3, n_shards)))


def test_mixing_of_clashing_names(docs):
    from tidemark.llm.mixing import mix_sources

    clash = docs.withColumnRenamed("lang", "mix_runs").withColumnRenamed("n_chars", "mix_run_name")
    assert mix_sources(clash, texts=True).columns == clash.columns
    assert mix_sources(clash, texts=True).count() > 0


def test_mixing_gives_back_the_words_it_takes(docs, rows):
    from pyspark.sql import functions as F

    from tidemark.llm.mixing import mix_sources

    mixed = mix_sources(docs, block_words=16, shard_slots=20)
    taken = mixed.agg(F.sum("n_words")).first()[0]
    made = mix_sources(docs, block_words=16, shard_slots=20, texts=True)
    assert made.columns == docs.columns
    got = made.collect()
    assert sum(len(words(r["text"])) for r in got) == taken
    source = defaultdict(Counter)
    for r in rows:
        source[r[0]].update(words(r[1]))
    assert all(set(words(r["text"])) <= set(source[r["doc_id"]]) for r in got)


def test_permutation_is_one():
    import numpy as np

    from tidemark.llm.mixing import permute, plan_slots

    for n in (1, 2, 3, 10, 1000, 4097):
        size, key = np.full(n, n), np.full(n, 99)
        there = permute(np.arange(n), size, key)
        assert sorted(there.tolist()) == list(range(n))
        assert (permute(there, size, key, inverse=True) == np.arange(n)).all()
    assert plan_slots(0, 10.0, 8, 1) == (0, 0, 0) and plan_slots(10, 0.0, 8, 1) == (0, 0, 0)


def test_line_dedup(docs, none, rows):
    from tidemark.llm.linededup import dedup_lines

    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            held[key(line)].add(-1 if r[0] is None else r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or r[0] == max(held[key(x)])]
        want[r[0], "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = dedup_lines(docs)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want
    assert sum(n for (_, _, _, gone), n in want.items() if gone) > 10
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert dedup_lines(none).count() == 0
    clash = docs.withColumnRenamed("lang", "ld_key").withColumnRenamed("source", "n_dropped")
    assert dedup_lines(clash).columns == ["doc_id", "text", "ld_key", "n_chars", "n_lines", "n_dropped"]


def test_line_dedup_of_very_many_lines(spark):
    import time

    from tidemark.llm.linededup import dedup_lines

    text = "\n".join(f"line {n} of a long text that five documents share" for n in range(30_000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string").repartition(2)
    begun = time.monotonic()
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in dedup_lines(docs).collect()}
    assert got == {i: (text, 0) if i == 4 else ("", 30_000) for i in range(5)}
    assert time.monotonic() - begun < 60


def brute_components(rows, n, percent):
    sets = []
    for r in rows:
        w = words(lower(r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[root(a)] = min(r[0], least.get(root(a), r[0]))
    return [(r[0], len(sets[a]), least.get(root(a))) for a, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "options"), [
    (4, 85, {}), (5, 80, {"frequent_list": 2}), (3, 50, {"block_sets": 4, "frequent_list": 1}), (4, 85, {"broadcast_rows": 0}),
    (5, 95, {"block_sets": 3}),
])
def test_near_duplicates(docs, none, rows, n, percent, options):
    from tidemark.llm.jaccard import near_duplicates

    got = near_duplicates(docs, n=n, percent=percent, **options).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_components(rows, n, percent))
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_keep_one(docs, none, rows, broadcast_rows):
    from tidemark.llm.jaccard import keep_one

    kept = keep_one(docs, broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    parts = brute_components(rows, 5, 80)
    # One row for each component; id 207 has two texts that make two components.
    want = Counter(i for i, n, c in parts if not n) + Counter({c: 1 for i, n, c in parts if n}) + Counter([207])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert keep_one(none).count() == 0


def test_only_texts_of_families_are_exchanged(spark):
    """Beyond what may be broadcast with its places, all texts were exchanged before."""
    from tidemark.llm import jaccard

    texts = [(n, 0, f"text number {n} with words {n // 2} of its own") for n in range(100)]
    body = spark.createDataFrame(texts, "id long, copy long, body string")
    sig = {n: jaccard.signature(jaccard.shingles(text, 4)) for n, _, text in texts}
    places = spark.createDataFrame(
        [(n, sig[n], 7, i, i, i) for n in (3, 5, 8) for i in range(4)], "id long, sig binary, family long, i int, j int, block int"
    )
    for broadcast_rows, semi in ((200, False), (5, True), (0, False)):
        read = jaccard._with_tokens(body, places, 4, broadcast_rows)
        got = Counter((bytes(r["sig"]), r["i"]) for r in read.collect())
        assert got == Counter((sig[n], i) for n in (3, 5, 8) for i in range(4))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert ("LeftSemi" in plan) == semi and ("SortMergeJoin" in plan) == (broadcast_rows < 200)


@pytest.mark.parametrize("broadcast_rows", [100, 10])
def test_near_duplicates_beyond_the_broadcast(docs, rows, broadcast_rows):
    from tidemark.llm.jaccard import near_duplicates

    got = near_duplicates(docs, n=4, percent=85, broadcast_rows=broadcast_rows, block_sets=3).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_components(rows, 4, 85))


def test_near_duplicate_workers_drop_what_bpe_remembers():
    """A worker kept the tokenizer and its words through all later stages before."""
    import pandas as pd
    import public_tokenizers
    from pyspark.sql.types import LongType, StructType

    from tidemark.llm import bpe, jaccard

    class Docs:
        schema = StructType().add("id", LongType())

        def mapInPandas(self, made, schema):
            return made

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe.tokenizer(file.read()).encode("some words")
    assert bpe.tokenizer.cache_info().currsize
    made = jaccard._prefixes(Docs(), 4, 85, None)
    assert [len(x) for x in made(iter([pd.DataFrame({"id": [1], "copy": [0], "body": ["a b"]})]))] == [1]
    assert not bpe.tokenizer.cache_info().currsize


def test_pairs_of_long_lists_come_in_parts():
    """All 162,560 pairs of a batch were one frame before."""
    import pandas as pd

    from tidemark.llm import jaccard

    class Lists:
        def mapInPandas(self, made, schema):
            return made

    lists = [[{"n": 300, "label": 1000 * k + n} for n in range(128)] for k in range(20)]
    parts = list(jaccard._pairs(Lists(), 85)(iter([pd.DataFrame({"list": lists})])))
    assert sum(map(len, parts)) == 20 * 128 * 127 // 2
    assert max(map(len, parts)) < jaccard.PAIRS + 128
    assert {tuple(x) for p in parts for x in p.itertuples(index=False)} == {
        (1000 * k + a, 1000 * k + b, 10) for k in range(20) for b in range(128) for a in range(b)
    }


def test_links_are_spanning_and_complete():
    import random

    import numpy as np

    from tidemark.llm.jaccard import Forest, links

    rng = random.Random(4)
    base = [np.unique(np.array(rng.sample(range(500), 40))) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = rng.sample(b.tolist(), rng.randint(28, len(b)))
            sets.append(np.unique(np.array(keep + rng.sample(range(1000, 2000), rng.randint(0, 4)))))

    def roots(pairs):
        forest = Forest(len(sets))
        for a, b in pairs:
            forest.join(a, b)
        return [forest.root(i) for i in range(len(sets))]

    every = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))
    ]
    found = links(sets, None, 70)
    assert roots(found) == roots(every) and len(found) < len(sets)
    half = len(sets) // 2
    parts = links(sets[:half], None, 70) + [(a + half, b + half) for a, b in links(sets[half:], None, 70)]
    parts += links(sets[:half], sets[half:], 70)
    assert roots(parts) == roots(every)


def test_bpe_equals_the_library(docs, none, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import ForcedBoundaryBPE, encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["don't STOP<|endoftext|>it's", "ΣΑΣ a\x1cb \u0085c", "İ ½²Ⅷ 💖👍🏽 日本語 각́", "'s's're <|startoftext|", "a" * 500, "\x00\n", "x_y-z"]
    with open(path, encoding="utf-8") as file:
        own = ForcedBoundaryBPE(file.read())
    for text in [*odd, *[r[1] or "" for r in rows]]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.encode_and_decode(text)[1] == library.decode(ids, skip_special_tokens=False) == own.decode(ids)
    made = encode_documents(docs.withColumnRenamed("lang", "decoded"), path).collect()
    assert len(made) == len(rows)
    for r in made:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert encode_documents(none, path).count() == 0


def test_other_vocabularies_are_refused():
    import json

    import public_tokenizers

    from tidemark.llm.bpe import ForcedBoundaryBPE

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    for part, value in (("normalizer", None), ("normalizer", {"type": "NFKC"}), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", None)):
        with pytest.raises(ValueError, match=part):
            ForcedBoundaryBPE(json.dumps({**spec, part: value}))


def test_forced_cuts_never_cross_a_token():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm.bpe import ForcedBoundaryBPE

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        own = ForcedBoundaryBPE(file.read())
    word = "日本w9ß-ÿ".encode()
    parts = own.cuts(word)
    assert b"".join(parts) == word and len(parts) > 1
    long = "abab" * 100
    assert own._merge_long([own._first[b] for b in long.encode()]) == own._merge_short([own._first[b] for b in long.encode()])


def test_plain_words_are_spelled_once():
    """ASCII letters need no pattern, and a quarter of a million words are remembered."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm.bpe import ForcedBoundaryBPE

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        own = ForcedBoundaryBPE(file.read())
    want = own.encode("Don't stop the press.")
    merge, merged = own._merge, []
    own._merge = lambda fragment, last: (merged.append(1), merge(fragment, last))[1]
    words = [f"{a}{b}{c}{d}" for a in "bdfgklmnprst" for b in "aeiouyvwxzqj" for c in "bcdfghjklmnpqrstvwxyz" for d in ("a", "es", "ing", "Ly", "tion", "ed", "or")]
    words = [w + v for w in words for v in ("", "t", "m", "no", "ke", "ru", "si", "la", "wo", "ph", "ou", "ee")]
    pattern, own._pattern = own._pattern, None
    first = own.encode_and_decode(" ".join(words))
    new = len(merged)
    assert new >= 250_000 and own.encode_and_decode(" ".join(words)) == first and len(merged) == new
    own._pattern = pattern
    assert own.encode("Don't stop the press.") == want


def test_remembered_words_take_bounded_bytes():
    """A worker keeps its words after the stage: 400,000 of them, short or long, take no more than 64 MiB."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sys import getsizeof

    from tidemark.llm.bpe import ForcedBoundaryBPE

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        own = ForcedBoundaryBPE(file.read())

    def size(value):
        return getsizeof(value) + (sum(map(size, value)) if isinstance(value, tuple) else 0)

    short = [f"{n:06x}".translate(str.maketrans("0123456789", "ghijklmnop")) for n in range(300_000)]
    long = [f"Ж{chr(0x4E00 + n % 20_000)}{n}日本語の長い文章" for n in range(100_000)]
    want = [own.encode_and_decode(" ".join(words[:100])) for words in (short, long)]
    for words in (short, long):
        own.encode_and_decode(" ".join(words))
        held = [d for memory in (own._words, own._chunks) for d in (memory.young, memory.old)]
        assert sum(getsizeof(d) + sum(map(size, d)) + sum(map(size, d.values())) for d in held) <= 64 << 20
    # What was forgotten is made anew, the same.
    assert [own.encode_and_decode(" ".join(words[:100])) for words in (short, long)] == want


def toxic_rows():
    out = []
    for i in range(240):
        text = " ".join(f"plain{(i * 13 + j * 7) % 400}" for j in range(20 + i % 40))
        bad = i % 6 == 0
        if bad:
            text += f" you {'idiot vermo' if i % 12 else 'glorb vermo'} {'glorb' if i % 18 else 'stupid'}"
        out.append((i, text, int(bad)))
    return out


def test_toxicity(spark, none):
    from tidemark.llm import toxicity

    table = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(900, None), (901, ""), (None, "vermo glorb")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in table if i % 4] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"vermo", "glorb"} <= set(model.weights)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("SCORE", docs.doc_id), model).collect()}
    assert all((got[i] >= 0.7) == bool(b) for i, _, b in table)
    assert got[900] == got[901] < 0.5 <= got[None]
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none.select("doc_id", "text"), labels)
    assert set(empty.weights) == set(toxicity.SEEDS)


def test_toxicity_learns_rare_words(spark):
    from tidemark.llm import toxicity

    # Fifteen of 2,000 toxic texts are of a language of their own.
    rows = [(n, f"a{n}x you {'grobnik' if n < 15 else 'common'}slur there", 1) for n in range(2000)]
    rows += [(n, f"b{n}x you kind word there", 0) for n in range(2000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert {"grobnikslur", "commonslur"} <= set(model.weights)
    assert not {"you", "there", "kind", "word"} & set(model.weights)


def test_toxicity_folds_and_spares():
    from tidemark.llm import toxicity

    model = toxicity.ToxicityModel({"idiot": 1.0, "trash": 1.0}, toxicity.EXCEPTIONS, (-3.0, 2.0, 1.0))
    automaton = model.automaton()
    assert toxicity.hits("you 1D10T!", automaton) == 1.0
    assert toxicity.hits("уou іdіоt", automaton) == 1.0
    assert toxicity.hits("ｉｄｉｏｔ", automaton) == 1.0
    assert toxicity.hits("idiotic idiots", automaton) == 0.0
    assert toxicity.hits("the trash\ncan, not trash", automaton) == 1.0
    assert toxicity.hits("", automaton) == 0.0


def test_toxicity_learns_words_of_ten_texts(spark):
    from tidemark.llm import toxicity

    rows = [(n, f"a{n}x you {'grobnik' if n < 10 else 'common'}slur there", 1) for n in range(4000)]
    rows += [(n, f"b{n}x you kind word there", 0) for n in range(4000, 12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert set(model.weights) == {"grobnikslur", "commonslur"}  # labels outweigh seeds that no toxic text has
    assert toxicity.fit(docs.drop("toxic").repartition(7), docs.drop("text")) == model


def test_toxicity_of_very_many_phrases():
    import time

    from tidemark.llm import toxicity

    automaton = toxicity.ToxicityModel({"trash": 1.0}, toxicity.EXCEPTIONS, (-3.0, 2.0, 1.0)).automaton()
    begun = time.monotonic()
    assert toxicity.hits("trash can, trash. " * 100_000, automaton) == 100_000
    assert time.monotonic() - begun < 20


def held_out(spark, sf, name, label, n, cut):
    """(right, all, caught, those there) among the labelled rows that the query held out."""
    from pyspark.sql import functions as F

    from tidemark.llm import queries

    scored = queries.queries()[name](spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("lab"))
    rows = scored.join(labels, "doc_id").where("lab is not null").collect()
    assert all((r["score"] >= cut) == bool(r["predicted"]) for r in rows)
    there = [r for r in rows if r["lab"]]
    return sum(r["predicted"] == r["lab"] for r in rows), len(rows), sum(r["predicted"] for r in there), len(there)


def test_held_out_toxicity_of_the_tables(spark, sf):
    right, every, caught, there = held_out(spark, sf.replace("0.01", "0.1"), "op3_toxicity", "toxic", 3, 0.7)
    assert there and right >= 0.98 * every and caught >= 0.75 * there


def test_held_out_quality_of_the_tables(spark, sf):
    right, every, _, there = held_out(spark, sf.replace("0.01", "0.1"), "op4_quality", "quality", 5, 0.3)
    assert there and right >= 0.98 * every


def test_quality(spark, none):
    from tidemark.llm import quality

    table = []
    for i in range(200):
        good = i % 4 != 0
        body = [f"word{(i * 17 + j * 5) % 300}" for j in range(30 + i % 20)]
        table.append((i, " ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in table if i % 3], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(i, g) for i, _, g in table if not i % 3]
    assert sum((got[i] >= 0.3) == bool(g) for i, g in held) >= 0.95 * len(held)
    assert got[900] == got[901] and 0.0 <= got[900] <= 1.0
    assert quality.score(none, model).count() == 0
    assert quality.fit(none.select("doc_id", "text"), labels).raw(*quality.encode("x", quality.Words())) == 0.0


def test_machine_scores_pairs_in_linear_time():
    import numpy as np

    from tidemark.llm.quality import FactorisationMachine

    rng = np.random.default_rng(1)
    machine = FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([2, 7, 30]), np.array([0.5, 1.0, 2.0])
    pairs = sum(
        machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b] for a in range(3) for b in range(a)
    )
    assert machine.raw(index, value) == pytest.approx(0.3 + machine.weight[index] @ value + pairs)


def test_digest_of_queries(spark, sf):
    """The registered queries on the small tables: one row for each row of the table."""
    from tidemark.llm import queries as q

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    found = q.op10_bpe(spark, sf).collect()
    assert len(found) == n and len(found[0]["ids_sha256"]) == 64
    lines = {r["doc_id"]: r for r in q.op6_line_dedup(spark, sf).collect()}
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first()["text"]
    if not lines[0]["n_dropped"]:
        assert lines[0]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("edge_rows", [30, 100_000])
def test_components_of_many_and_of_one_partition(spark, edge_rows):
    """Random graphs, a path and a star with a large-named hub, against a plain union-find."""
    from tidemark.llm import jaccard

    rng = random.Random(edge_rows)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(999, 400 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    found = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(4), edge_rows).collect()
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    assert jaccard.components(spark.createDataFrame([], "a long, b long"), edge_rows).collect() == []
