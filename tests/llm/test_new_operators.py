"""Vector codes, the source audit and the mix, against plain versions, on odd tables and on hot ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from lectern.llm import mixing, sourceaudit, vectorcodes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_source_audit"])
def test_query_equals_its_sql(spark, name):
    assert compare.compare(spark, SF, name) == ""


# ---- vector codes


def test_masks_find_what_all_distances_find():
    rng = np.random.default_rng(1)
    for n, dims, spread in ((256, 16, 300), (256, 3, 5), (70, 1, 1000), (1, 4, 10), (256, 16, 1)):
        book, x = rng.integers(-spread, spread, (n, dims)), rng.integers(-2 * spread, 2 * spread, (3000, dims))
        book[n // 2 :] = book[: n - n // 2]  # entries that are equal: the lower one wins
        d = np.square(x[:, None] - book[None]).sum(2)
        entry, distance = vectorcodes.Slices(book).nearest(x)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_masks_within_a_radius_are_exact():
    rng = np.random.default_rng(2)
    book, x = rng.integers(-50, 50, (200, 4)), rng.integers(-60, 60, (500, 4))
    masks = vectorcodes.Slices(book).within(x, np.full(500, 20))
    got = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :200].astype(bool)
    assert (got == (np.abs(x[:, None] - book[None]).max(2) <= 20)).all()


def plain_codes(rows):
    """[(vec_id, label, vector)] of usable vectors -> {row: (code, error)}, sha256."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[2]))
    x = np.array([[int(np.floor(1024 * c)) for c in r[2]] for r in rows])
    m, codes, errors, books = x.shape[1] // 4, [], 0, []
    for p in range(4):
        own = x[:, p * m : (p + 1) * m]
        book = own[:256].copy()
        for last in (False,) * 4 + (True,):
            d = np.square(own[:, None] - book[None]).sum(2)
            at = d.argmin(1)
            if not last:
                for e in set(at.tolist()):
                    book[e] = own[at == e].sum(0) // (at == e).sum()
        codes.append(at)
        errors = errors + d.min(1)
        books.append(book)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(r[0], r[1], "".join(f"{c[i]:02x}" for c in codes), int(errors[i])) for i, r in enumerate(rows)], sha


def test_codes_equal_plain_ones_on_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None]), [rng.gauss(0, 1) for _ in range(8)], "x") for i in range(400)]
    rows += rows[:3] + [(None, 1, [0.5] * 8, "x"), (7, 2, [-0.25] * 8, "x")]
    odd = [(900, 1, None, "x"), (901, 1, [1.0, None] * 4, "x"), (902, 1, [float("nan")] * 8, "x"), (903, 2, [float("-inf")] + [0.0] * 7, "x"), (904, 1, [], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>, code string")
    want, sha = plain_codes([r[:3] for r in rows])
    got = vectorcodes.compressed(table).collect()
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((i, code, error, total[label]) for i, label, code, error in want)
    assert {r.codebooks_sha256 for r in got} == {sha}
    few = vectorcodes.compressed(table.filter("vec_id < 3")).collect()
    assert sorted(r.code for r in few) == ["00000000", "00000000", "01010101", "01010101", "02020202", "02020202"] or {r.error for r in few} == {0}
    assert vectorcodes.compressed(table.limit(0)).count() == 0 and vectorcodes.compressed(table.filter("vec_id = 900")).count() == 0


def test_decoded_vectors_are_as_far_as_the_errors_say(spark):
    rows = vectorcodes.kept(spark.read.parquet(f"{SF}/embeddings.parquet"))
    books = vectorcodes.fit(rows)
    back = vectorcodes.decode(vectorcodes.encode(rows, books), books).join(rows.withColumnRenamed("v", "given").drop("label"), "vec_id").collect()
    for r in back:
        assert np.square(np.floor(np.array(r.given) * 1024) - (np.array(r.v) * 1024 - 0.5)).sum() == r.error


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="aren't exact"):
        vectorcodes.compressed(spark.createDataFrame([(1, 1, [1e9] * 4)], "vec_id long, label int, embedding array<double>"))


# ---- source audit


def plain_counts(docs, min_docs=3):
    n, df = Counter(), defaultdict(set)
    for k, (lang, source, text) in enumerate(docs):
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            n[lang or "", source or "", w] += 1
            df[lang or "", w].add(k)
    return n, {k for k, d in df.items() if len(d) >= min_docs}


def plain_audit(docs):
    n, kept = plain_counts(docs)
    groups = sorted({(d[0] or "", d[1] or "") for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for k, t in kept if k == lang]
        sources = [s for k, s in groups if k == lang]
        c = {s: {t: n[lang, s, t] for t in terms} for s in sources}
        of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms}  # noqa: E731,B023
        p, q = {s: of(c[s]) for s in sources}, of({t: sum(c[s][t] for s in sources) for t in terms})
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in terms if c[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, x[2], -x[0], k) for part, rows in (("pair", sorted(pairs)), ("term", sorted(own)[:200])) for k, x in enumerate(rows, 1)]
    return out


def words(rng, n):
    base = ["the", "The", "naïve", "ÉCOLE", "école", "x", "abcdefgh", "abcdefghi", "abcdefghij", "ABCDEFGH", "中文字", "a" * 40, "a" * 41, "a" * 39 + "b", "don't", "q1w", "e_mail"]
    return " ".join(rng.choice(base + [f"w{'abcdefghij'[rng.randrange(10)]}{'klmnop'[rng.randrange(6)]}"]) for _ in range(n))


@pytest.mark.parametrize("shard,cut,rows,cells", [(sourceaudit.SHARD_BYTES, sourceaudit.SLICE, sourceaudit.PAIR_ROWS, sourceaudit.CELLS), (300, 8, 20, 6)])
def test_audit_equals_a_plain_one(spark, monkeypatch, shard, cut, rows, cells):
    for name, value in (("SHARD_BYTES", shard), ("SLICE", cut), ("PAIR_ROWS", rows), ("CELLS", cells)):
        monkeypatch.setattr(sourceaudit, name, value)
    rng = random.Random(5)
    docs = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "中", None, ""]), words(rng, rng.randrange(60))) for _ in range(120)]
    docs += [("fr", "only", "nothing twice"), ("fr", "bare", None), ("xx", "s", "1 2 3"), ("xx", "t", ""), docs[0], docs[0], ("en", "a", words(rng, 3000))]
    table = spark.createDataFrame([(*d, 1, "n") for d in docs], "lang string, source string, text string, n int, term string")
    got = sourceaudit.audit(table).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(docs))


def test_audit_of_no_documents(spark):
    assert sourceaudit.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_runs_are_equal_words():
    rng = random.Random(9)
    text = words(rng, 4000).encode() + b"A"
    data = np.frombuffer(text, np.uint8)
    starts, lengths = sourceaudit.pointers(data, np.array([len(data)]))
    low = sourceaudit.LOWER[data]
    for cut in (4, 100, 1 << 16):
        sourceaudit.SLICE, old = cut, sourceaudit.SLICE
        run, heads = sourceaudit.runs(low, starts, lengths)
        sourceaudit.SLICE = old
        got = [bytes(low[a : a + n]) for a, n in zip(starts, lengths, strict=True)]
        assert len(set(zip(run.tolist(), got, strict=True))) == len(set(got)) == len(heads) and all(run[h] == k for k, h in enumerate(heads))


@pytest.mark.parametrize("size", [7, 64, 1000, 10**6])
def test_a_long_text_is_counted_in_pieces(monkeypatch, size):
    monkeypatch.setattr(sourceaudit, "SHARD_BYTES", size)
    text = words(random.Random(6), 3000) + " " + "é" * 500 + " end"
    term, n = sourceaudit._long(np.frombuffer(text.encode(), np.uint8))
    want = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
    assert dict(zip(term.to_pylist(), n.tolist(), strict=True)) == want


# ---- mixing


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def checked(rows, near=0.02):
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = plain_targets(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) <= 1e-6 * (1 + want[s])
        assert abs(taken[s] - want[s]) <= max(near * want[s], 1) or abs(taken[s] - want[s]) <= largest[s]
    return size, taken, want


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    size, taken, want = checked(rows)
    assert all(abs(taken[s] - want[s]) <= 0.002 * want[s] + 2 for s in size)
    assert sum(abs(r.copies - r.rate) >= 1 for r in rows if r.size) <= 40  # only what was mended
    again = mixing.mix(docs.repartition(13)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    n_words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert all(n_words[r.doc_id] == r.size for r in rows)


def test_rates_are_the_least_relative_entropy(spark):
    """Among rates that meet a target, none moved a little along it is nearer to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in mixing.mix(docs).collect() if r.size and 0 < r.rate < 3]
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    tested = 0
    for own in by.values():
        tilt = [np.log(r.rate) / r.size for r in own]
        assert max(tilt) - min(tilt) <= 1e-9 * max(map(abs, tilt)) + 1e-15
        tested += len(own) > 1
    assert tested > 3


def test_mix_of_odd_and_hot_tables(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 90)), rng.choice(["a", "b", "é", "z", None])) for i in range(300)]
    rows += [(1000, "same words here " * 5, "hot")] * 500 + [(None, "x y", "hot")] * 20 + [(5, None, "zero"), (6, "", "zero"), (7, " \t\x0b ", None), (8, "long " * 50_000, "b")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, copies int")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    checked(got)
    assert {r.target for r in got if r.source == "zero"} == {0.0}
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(table.repartition(7)).collect()))


def test_mix_of_edge_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "s")], schema)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in one] == [(3, 3, 3.0, 3)]
    none = mixing.mix(spark.createDataFrame([(1, None, "s"), (2, "", None)], schema)).collect()
    assert all(r.taken == 0 and r.target == 0.0 for r in none)
    rows = [(k, "w " * 10, s) for k, s in enumerate("aaaaaaaaaaaaaaaabc")]  # b and c are small: b stops at three times its words
    checked(mixing.mix(spark.createDataFrame(rows, schema)).collect())


def test_mix_stays_in_the_jvm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
