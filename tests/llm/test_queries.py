"""The registered queries on the smallest tables, and the pipeline against its parts."""

import re
import zlib
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = [tuple(map(str, r)) for r in df.select(*cols).collect()]
    theirs = [tuple(map(str, r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()]
    assert sorted(ours) == sorted(theirs)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name, columns):
    """The rows of a registered query, which has those columns at least."""
    df = queries.queries()[name](spark, SF)
    assert set(columns) <= set(map(tuple, df.dtypes)), df.dtypes
    return df.collect()


def test_op2_links_fingerprints_as_brute_force_does(spark, documents):
    from test_ops import brute_components, slow_fingerprint

    rows = result(spark, "op2_simhash_near_dedup", [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")])
    ids = sorted(documents)
    prints = [slow_fingerprint(documents[i]["text"]) for i in ids]
    root = brute_components(prints, 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, root, strict=True)}


def test_op3_predicts_held_out_languages(spark, documents):
    rows = result(spark, "op3_language_id", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    assert len(rows) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and any(c.isalpha() for c in documents[r["doc_id"]]["text"] or "")]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in documents[r["doc_id"]]["text"] or "")) for r in rows)


def test_op4_packs_every_id_once(spark, documents):
    import numpy as np
    from tokenizers import Tokenizer

    from tessera.llm.packing import vocabulary

    rows = result(spark, "op4_packing", [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    plain, by = Tokenizer.from_file(vocabulary()), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(documents)
    for i, own in by.items():
        ids = np.array([*plain.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


def test_op5_takes_words_near_the_targets(spark, documents):
    from test_ops import slow_targets

    rows = result(spark, "op5_mixing", [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")])
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", d["text"] or "") if w]) for i, d in documents.items()}
    sums = {}
    for i, d in documents.items():
        sums[d["source"]] = sums.get(d["source"], 0) + size[i]
    want, taken = slow_targets(sums), {}
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source] and abs(r["target"] - want[source]) < 1e-6 * want[source] + 1e-6 and r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert len(rows) == len(documents) and all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)  # ten documents a source


def test_op8_finds_the_links_of_brute_force(spark):
    import numpy as np

    rows = {r["vec_id"]: r for r in result(spark, "op8_embedding_near_dedup", [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])}
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in table])
    links = ((x @ x.T >= 0.98) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    assert len(rows) == len(table) and all(rows[r["vec_id"]]["n_links"] <= n for r, n in zip(table, links, strict=True))
    assert sum(r["n_links"] for r in rows.values()) >= 0.95 * links.sum() and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())


def test_op10_gives_the_text_and_its_length(spark):
    rows = result(spark, "op10_html_extract", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")])
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"]: r["url"] for r in rows} == urls and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def shingles(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    near = rows.where("n_chars > 3000").limit(3).withColumn("doc_id", F.col("doc_id") + 100000).withColumn("text", F.concat("text", F.lit(" tail")))
    odd = spark.createDataFrame([(200001, None, "en", "a", 0), (200002, "12 34", None, None, 5)], rows.schema)
    docs = rows.unionByName(near).unionByName(odd)
    named = dict(p.STAGES)
    assert list(named) == ["language_id", "near_dedup", "mix_sources", "packing"] and p.ORACLE_SQL is None

    def stage(name, df):
        out = named[name](spark, df, SF)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    kept = stage("language_id", docs)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 2
    unique = stage("near_dedup", kept)
    sets = {r["doc_id"]: shingles(r["text"], p.SHINGLE) for r in kept.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for a in ids:
        near_ = [b for b in ids if len(sets[a] & sets[b]) >= p.SIMILARITY * len(sets[a] | sets[b])]
        low, old = min(root[b] for b in near_), {root[b] for b in near_}
        root = {i: low if r in old else r for i, r in root.items()}
    left = {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert left == set(root.values()) and not left & set(range(100000, 200000))
    mixed = stage("mix_sources", unique)
    assert mixed.columns == docs.columns and 1.3 < mixed.agg(F.sum("n_chars")).first()[0] / unique.agg(F.sum("n_chars")).first()[0] < 1.7
    packed = stage("packing", mixed)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).join(mixed.groupBy("doc_id").count(), "doc_id")
    assert sums.where("n <> t * count").isEmpty() and sums.count() == mixed.select("doc_id").distinct().count()


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).count() > 0


#: Names that stages use for columns of their own.
HELPERS = ["bits_", "likely_", "word_", "bits", "key", "row", "n", "id", "fp", "part", "size", "kept", "keep_0", "digest", "score", "lang_pred", "component_id", "target", "u", "v", "length", "start"]


@pytest.mark.parametrize("k", range(4))
def test_a_stage_keeps_its_rows_whatever_the_number_of_executors(spark, tmp_path, k):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "und das hier", "de", None, 12), (3, "same text", "en", "a", 9), (3, "same text", "en", "a", 9)], rows.schema)
    rows.unionByName(odd).withColumn("row_number_", F.lit("x")).withColumn("copies", F.lit(7)).withColumn("turns_", F.lit(None).cast("string")).withColumns({c: F.lit("y") for c in HELPERS}).repartition(8).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    _, stage = p.STAGES[k]
    key = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(key, "8")
        out = stage(spark, docs, SF)
        first = sorted(map(str, out.drop("part").collect()))
        spark.conf.set(key, "2")
        assert sorted(map(str, out.drop("part").collect())) == first and first
        if k < 3:
            assert out.columns == docs.columns and {r["row_number_"] for r in out.collect()} == {"x"}
    finally:
        spark.conf.unset(key)


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
