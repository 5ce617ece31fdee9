"""The corpus queries that SQL can express, against DuckDB on the small tables."""

from pathlib import Path

import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{Path(sf, table)}.parquet')")
    got = queries.queries()[name](spark, sf).toPandas()
    want = connection.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(want) > 0
    plain = lambda frame: sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))
    assert plain(got) == plain(want)


def test_contracts(spark, sf):
    """Columns and types that the queries return."""
    want = {
        "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op5_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
        "op7_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint",
        "op8_nearest": "query_id bigint, rank int, vec_id bigint, score double",
        "op9_main_text": "page_id bigint, url string, text string, n_chars bigint",
        "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string",
        "op12_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        "op13_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    }
    small = sf.replace("0.01", "0.001")
    assert set(queries.queries()) == set(want)
    for name, schema in want.items():
        found = queries.queries()[name](spark, small)
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == schema, name


def test_shards_of_the_whole_table(spark, sf):
    """The law of equal bytes: all documents once, right sizes and checksums, gapless slots, shards near their share."""
    import zlib
    from collections import Counter, defaultdict

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    total, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[data].add(r["shard"])
    assert set(total) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(total.values()) / 8, max(r["size"] for r in rows)
    assert all(abs(n - share) <= 0.02 * share + largest for n in total.values())
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_mix_of_the_whole_table(spark, sf):
    """All documents once, sizes by counting words, targets by resharing, each source's words near its target."""
    import re
    from collections import Counter, defaultdict

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in table}
    source = {r["doc_id"]: r["source"] for r in table}
    sizes = defaultdict(int)
    for i, n in words.items():
        sizes[source[i]] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, stopped = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}, set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)) / sum(w for s, w in weight.items() if s not in stopped)
        over = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    target = {s: 3 * sizes[s] if s in stopped else level * weight[s] for s in order}
    rows, taken = queries.op2_mixing(spark, sf).collect(), Counter()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(words))
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], sizes[s]) and abs(r["target"] - target[s]) < 1e-6 * target[s] + 1e-9
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
