"""The ten operators: against their SQL, the libraries, brute force, round trips or held-out rows, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lectern.llm import bpe, chat, components, ctw, dartminhash, decontaminate, licence, pii, quality, queries, tokencount, warc
from lectern.llm.common import fresh_path, shared_dir

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Nulls, empty and long texts, ties, repeated rows.
ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "word " * 3000), (5, "word " * 3000), (6, "a\x1cb é 中文 1½ don't"), (7, "x" * 30_000), (8, "line\nline\nline")]


def frame(spark, rows, tmp_path, extra=True):
    """As read from files, with columns that clash with the operators' own names."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        d = d.selectExpr("doc_id", "text", "'x' AS words", "1 AS class", "'y' AS digest", "2 AS block", "3 AS n", "'z' AS lang")
    d.coalesce(2).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare.compare(spark, SF, name) == ""


def test_quality_odd(spark, tmp_path):
    rows = quality.ledger(frame(spark, ODD, tmp_path)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].n_repeat_words == by[5].n_words == 3000 and by[8].n_dup_lines == 2 and by[6].n_words == 5
    assert quality.ablation(quality.ledger(frame(spark, ODD, tmp_path / "b"))).count() == sum(map(len, quality.POLICIES.values()))
    assert quality.kept(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_pii(t):
    out = [("email", x.start(), x.end()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", x.start(), x.end()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))]
    for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", x[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", x.start(), x.end()))
    return out + [("phone", x.start(), x.end()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", x[0])) <= 15]


def test_base_spans_equal_the_patterns():
    random.seed(0)
    for _ in range(20_000):
        t = "".join(random.choice("a.@1-2+ (%)9é") for _ in range(random.randint(0, 40)))
        assert brute_pii(t) == pii.base_spans(t)


def test_field_adds_what_is_repeated(spark, tmp_path):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    spans = pii.spans_of(["Write to jan.kowalski.77@mail4.example.com. Later jan.kowalski.77@mail4 wrote.", "Call +1 (678) 555-5272 or 1 (678) 555-5272 then", "In 2024 there were 12 of 34."], model)
    assert [(k, b) for k, _, _, b in spans[0]] == [("email", True), ("email", False)]
    assert ("phone", False) in [(k, b) for k, _, _, b in spans[1]] and spans[2] == []
    rows = pii.digests(pii.find(frame(spark, ODD, tmp_path), model)).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)


def test_loopy_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    node, pair, edges = rng.normal(size=(3, 5)), rng.normal(size=(1, 5, 5)), np.array([[0, 1, 0], [1, 2, 0]])
    got = np.exp(pii.propagate(node, edges, pair, 50)[0])
    p = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + pair[0][:, :, None] + pair[0][None, :, :])
    p /= p.sum()
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-3)


def brute_classes(d):
    sets = {i: set(dartminhash.shingles(t)[0].tolist()) for i, t in d.items()}
    root = {i: i for i in d}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if d[a] == d[b] or union and len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in d}


def test_near_duplicates_equal_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.op3_dart_minhash(spark, SF).collect()}
    assert got == brute_classes(docs(spark))


def test_left_of_a_bucket_is_joined_in_blocks(spark, monkeypatch):
    """Two families in one bucket, over several blocks: links join each family, none joins both, and fewer come than pairs."""
    from lectern.llm.common import cut

    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    rows = [(i, " ".join([f"{'ab'[i % 2]}{k}" for k in range(60)] + [f"end{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [dartminhash.shingles(t) for _, t in rows]
    sig = dartminhash.signatures([(x, np.ones(len(x))) for x, _ in sets])
    reps = spark.createDataFrame([(i, [7] * 32, bytearray(s.astype(np.uint8).tobytes())) for i, s in enumerate(sig)], "id long, bands array<long>, low binary")
    placed = cut(reps.selectExpr("id", "0 AS band", "1L AS bucket", "id AS class"))
    links = {tuple(r) for r in dartminhash._left(placed, reps, docs, 0.8, False, 2).collect()}
    assert len(links) < 90 and all((a - b) % 2 == 0 for a, b in links)
    classes = {r["id"]: r["class"] for r in dartminhash.components(spark.createDataFrame(list(links), "a long, b long")).collect()}
    assert classes == {i: i % 2 for i in range(20)}


def test_near_duplicates_odd(spark, tmp_path):
    rows = dartminhash.near_duplicates(frame(spark, [*ODD, (9, "one"), (10, "")], tmp_path)).collect()
    got = {r.doc_id: r["class"] for r in rows if r.doc_id is not None}
    assert len(rows) == len(ODD) + 2 and got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 4, 10: 1}


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    items, w = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64)), rng.uniform(0.1, 9, 500)
    v = w * rng.uniform(0.5, 2, 500)
    s = dartminhash.signatures([(items, w), (items, v)], k=2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r["class"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_ctw(rows):
    depth, seen = ctw.DEPTH, collections.defaultdict(lambda: [0, 0])

    def steps(t):
        b = bytes(depth) + t.encode().lower() + b"\0"
        for i in range(depth, len(b)):
            prefix = 1
            for k in range(8):
                bit = (b[i] >> (7 - k)) & 1
                yield b[i - depth : i], prefix, bit
                prefix = prefix * 2 + bit

    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            for c, p, bit in steps(t or ""):
                for d in range(depth + 1):
                    seen[c[depth - d :], p][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    lw, below = {}, collections.defaultdict(float)
    for d in range(depth, -1, -1):
        for (c, p), (a, b) in [x for x in seen.items() if len(x[0][0]) == d]:
            lw[c, p] = kt(a, b) if d == depth else math.log(0.5) + np.logaddexp(kt(a, b), below[c, p])
            below[c[1:], p] += lw[c, p] if d else 0
    out = {}
    for i, t in rows:
        total = 0
        for c, p, bit in steps(t or ""):
            have, left = 0.0, 1.0
            for d in range(depth + 1):
                key = c[depth - d :], p
                a, b = seen.get(key, (0, 0))
                share = 1.0 if d == depth else math.exp(math.log(0.5) + kt(a, b) - lw.get(key, 0.0))
                have, left = have + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)
            total += math.log10(have if bit else 1 - have)
        out[i] = total
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_ctw_equals_brute_force(spark, tmp_path, most):
    rows = [*sorted(docs(spark).items())[:8], (900, ""), (901, "zqé 中"), (None, None)]
    got = {r.doc_id: r for r in ctw.score(frame(spark, rows, tmp_path), most=most).collect()}
    for i, want in brute_ctw(rows).items():
        assert got[i].score == pytest.approx(want, rel=1e-9)
    train = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t.encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in rows:
        own = (t or "").encode().lower().split()
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in own), len(train)])
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(own) + 1 and got[i].train_tokens == n


def test_ctw_repeated_rows(spark, tmp_path):
    assert ctw.score(frame(spark, ODD, tmp_path)).count() == len(ODD)


def test_licences_held_out(spark, tmp_path):
    model = licence.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = [(t, k) for t, k in licence.training_rows(["er the of onto"], seed=9) if k]
    assert np.mean([licence.FAMILIES[k] == model.predict(t)[0] for t, k in held]) > 0.9
    rows = licence.scan(frame(spark, [*ODD, (20, "a\nReleased under the MIT License.\nb"), (21, "w " * 500 + "Licensed under CC BY-NC 4.0. " + "w " * 500), (22, "mit der license")], tmp_path), model).filter("confirmed").collect()
    assert {(r.doc_id, r.family) for r in rows} == {(20, "mit"), (21, "cc-by-nc")} and [(r.start, r.stop) for r in rows if r.doc_id == 20] == [(2, 33)]


def test_chat_odd(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 1, "b", None), (1, None, None, "é"), (None, 0, "a", "x"), (1, 200, "a", "late")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.perspective, r.part): r for r in got}
    first, last = by[1, "a", 0], by[1, "a", 3]
    assert first.text == "<|assistant|>\nhi<|end|>\n" + "<|user|>b\n<|end|>\n" * 2 and first.mask == "14:24" and by[1, "unknown", -1].text == "<|assistant|>\né<|end|>\n"
    assert last.offset == len(by[1, "a", -1].text) + len(first.text) and by[None, "a", 0].n_messages == 1
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe_equals_the_library(spark, tmp_path):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    rows = [*ODD, *docs(spark).items(), (11, "tab\tand  double  spaces \n\n x' 'S 're"), (12, "<|endoftext|>"), (13, "a" * 5000)]
    got = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode(frame(spark, rows, tmp_path), RANKS, block_chars=20_000).collect())
    assert got == collections.Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_token_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, d, cache = Tokenizer.from_file(path), frame(spark, [*ODD, (9, "a <|endoftext|> b")], tmp_path), fresh_path(spark, "cache")
    rows = tokencount.token_counts(d, path, cache).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in [*ODD, (9, "a <|endoftext|> b")]) and not any(r.cached for r in rows)
    assert all(r.cached for r in tokencount.token_counts(d, path, cache).collect())
    assert not any(r.cached for r in tokencount.token_counts(d.limit(1), public_tokenizers.path("word_bpe_49k.json"), cache).collect())


def test_salvage_recovers_around_damage():
    records = [warc.record(i, f"http://x/{i}", f"<p>{i} \x1f é</p>".encode() * 20) for i in range(6)]
    members = [warc.gzip_member(r) for r in records]
    whole = b"".join(members)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6
    cut = whole[: len(members[0]) + 30] + b"\xff" * 40 + whole[len(members[0]) + 70 :]
    got = list(warc.salvage(cut))
    assert [x[4]["page_id"] for x in got if x[0] == "record"] == [0, 2, 3, 4, 5] and [x[:3] for x in got if x[0] == "gap"] == [("gap", len(members[0]), len(members[0]) + len(members[1]))]
    plain = b"".join(records)
    bad = bytearray(plain)
    bad[len(records[0]) + len(records[1]) - 30] ^= 1
    assert [x[4]["page_id"] for x in warc.salvage(bytes(bad)) if x[0] == "record"] == [0, 2, 3, 4, 5]
    assert [x[0] for x in warc.salvage(whole[:-5])] == ["record"] * 5 + ["gap"] and list(warc.salvage(b"")) == []
    spans = sorted(x[1:3] for x in warc.salvage(cut))
    assert spans[0][0] == 0 and spans[-1][1] == len(cut) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_warc_round_trip_odd(spark):
    pages = spark.createDataFrame([(1, "http://a", None), (2, None, ""), (3, "u é", "same"), (4, "u", "same"), (4, "u", "same"), (None, "n", "alone")], "page_id long, url string, html string")
    rows = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert rows == [("1", 0, "revisit", 2), ("2", 0, "response", None), ("3", 4, "revisit", 4), ("4", 4, "response", None), ("4", 4, "response", None), ("None", 5, "response", None)]


def edited(share):
    def go(t, rng):
        t = bytearray(t)
        for _ in range(int(len(t) * share)):
            p, c = int(rng.integers(0, len(t))), int(rng.integers(97, 123))
            k = int(rng.integers(0, 3))
            if k == 0:
                t[p] = c
            elif k == 1:
                del t[p]
            else:
                t.insert(p, c)
        return bytes(t)

    return go


def test_decontamination(spark, tmp_path):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert decontaminate.recall(items, edited(0.05)) > 0.95 and decontaminate.recall(items, edited(0.08)) > 0.9
    rng, filler = np.random.default_rng(3), "lorem ipsum dolor sit amet consectetur " * 5
    rows = [(i, filler + edited(0.06)(decontaminate.normalise(t), rng).decode(errors="replace") + " " + filler) for i, t in items] + [(1000 + i, t) for i, t in ODD if i]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contamination(frame(spark, rows, tmp_path), spark.createDataFrame([*items, (None, "x"), (99, None), (98, "tiny")], "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        for k, item in items:
            x = decontaminate.normalise(item)
            n, _ = decontaminate.distance(x, decontaminate.normalise(t or ""))
            if n <= decontaminate.edits_allowed(len(x)):
                want[i, k] = n
    assert got == want and len(want) > 30


def test_distance():
    assert decontaminate.distance(b"abcdef", b"xxabdefyy")[0] == 1 and decontaminate.distance(b"abc", b"")[0] == 3 and decontaminate.distance(b"", b"x")[0] == 0


def test_pipeline_equals_its_parts(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    d = docs(spark)
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, SF).filter("kept").collect()}
    classes = brute_classes({i: d[i] for i in kept})
    kept = {i for i in kept if classes[i] == i}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(decontaminate.distance(x, decontaminate.normalise(d[i]))[0] <= decontaminate.edits_allowed(len(x)) for x in items)}
    assert set(got) == kept
    clean = [i for i in kept if not re.search("[0-9@]", d[i])]
    assert clean and all(got[i].decoded_sha256 == hashlib.sha256(d[i].encode()).hexdigest() for i in clean)


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)).rstrip("/")
