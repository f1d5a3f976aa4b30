"""Empty tables, clashing columns, very long texts, hot texts and damaged archives, through Spark."""

import pytest

import corpus_pipeline
from lectern.llm import bpe, chat, ctw, quality, tokencount, warc
from lectern.llm.common import fresh_path, shared_dir

import public_tokenizers

RANKS, TOKENS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_empty_tables(spark):
    d = empty(spark)
    assert bpe.encode(d, RANKS).count() == 0 and ctw.score(d).count() == 0 and tokencount.token_counts(d, TOKENS, fresh_path(spark, "cache")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality.ablation(quality.ledger(d)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0


def test_stages_take_nulls(spark, tmp_path):
    d = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "plain words that go on for a while and end here, with more of them to be kept", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, d, SF).collect()
        assert any(r.doc_id == 2 for r in rows) and len(rows) == (1 if k == 0 else 3)


def test_clashing_columns(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "a", "x" * 200_000, 7, 8), (1, 1, "b", "y", 7, 8)], "conv_id long, turn long, role string, text string, part long, offset long")
    rows = chat.rotate(c).collect()
    assert len(rows) == 2 and {len(r.text) for r in rows} == {200_000 + 14 + 8 + 10 + 1 + 8, 200_000 + 10 + 8 + 14 + 1 + 8}
    p = spark.createDataFrame([(1, "u", "z" * 3_000_000, 1, "q"), (2, "u", "z" * 3_000_000, 1, "q")], "page_id long, url string, html string, sha1 int, last string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(p).collect()}
    assert got == {1: (3_000_000, "revisit", 2), 2: (3_000_000, "response", None)}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_hot_texts_and_no_broadcasts(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(tokencount, "BROADCAST_IDS", limit)
    monkeypatch.setattr(tokencount, "HOT", 5)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
    rows = [(i, "hot text here") for i in range(50)] + [(100 + i, f"text {i}") for i in range(20)] + [(None, "hot text here"), (None, None), (7, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS n", "3 AS rep").write.parquet(str(tmp_path / "d"))
    d, cache = spark.read.parquet(str(tmp_path / "d")), fresh_path(spark, "cache")
    got = tokencount.token_counts(d, TOKENS, cache).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.n_bytes == 13} == {3} and not any(r.cached for r in got)
    assert all(r.cached for r in tokencount.token_counts(d, TOKENS, cache).collect())
    pages = d.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows) and sum(r.record_type == "response" for r in out) == 20 + 1 + 1 + 1 + 1 and {r.refers_to for r in out} == {None, 49}


def test_damaged_archives_are_read_around(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    to = fresh_path(spark, "warc")
    name = warc.write_archives(warc.with_revisits(pages), to).first().archive
    path = f"{to.removeprefix('file:').removeprefix('//')}/{name}"
    members = [r.start for r in warc.read_archives(spark, to).filter("kind = 'record'").orderBy("start").collect()]
    data = bytearray(open(path, "rb").read())
    data[members[5] + 12] ^= 0xFF
    data[members[20] : members[20] + 3] = b"\0\0\0"
    open(path, "wb").write(bytes(data[: members[39] + 20]))
    rows = warc.read_archives(spark, to).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [i for i in range(39) if i not in (5, 20)]
    gaps = sorted((r.start, r.stop) for r in rows if r.kind == "gap")
    assert gaps == [(members[5], members[6]), (members[20], members[21]), (members[39], members[39] + 20)] and all(r.reason for r in rows if r.kind == "gap")


def test_decode_is_the_inverse(spark, tmp_path):
    spark.createDataFrame([(1, "añ 中 x"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    e = bpe.encode(spark.read.parquet(str(tmp_path / "d")), RANKS)
    assert {r.doc_id: bytes(r.b) for r in e.select("doc_id", bpe.decode("ids", RANKS).alias("b")).collect()} == {1: "añ 中 x".encode(), 2: b""}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decoded(bpe.encode(docs, RANKS).select("doc_id", "ids"), RANKS).collect()}
    assert got == {r.doc_id: r.text.encode() for r in docs.collect()}
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decoded(odd, RANKS).collect()} == {1: None, 2: b""}


def test_shared_dir_is_an_error_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_a_stored_ledger_serves_policies_and_ablations(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.store(docs, str(tmp_path / "ledger"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, quality.ledger(docs).collect()))
    assert sorted(map(tuple, quality.ablation(rows).collect())) == sorted(map(tuple, quality.ablation(quality.ledger(docs)).collect()))
    assert rows.filter(quality.passes("prose/1")).count() == quality.kept(docs, "prose/1").count()
