"""Quotations on pages: slips, gaps, repeats, nulls; the band against the whole table of alignments."""

import random

from lectern.operators import highlight as H

WORDS = "presupuesto obra tabique yeso laminado espesor perfil acero norma plano vivienda cocina pared suelo techo puerta ventana modulo cantidad precio".split()


def test_forms_and_near_words():
    assert H.form("Ñáb0,") == "nabo" and H.form("m0derno") == H.form("modemo") and H.form("--") == ""
    assert H.near("acero", "acerro") and H.near("acero", "cero") and H.near("acero", "acera") and not H.near("acero", "aceras") and not H.near("abc", "abd") and H.near("acero", "acero")


def test_the_band_finds_what_the_whole_table_finds():
    rng, same = random.Random(1), 0
    for _ in range(150):
        page = [rng.choice(WORDS) + str(rng.randrange(6)) for _ in range(rng.randrange(20, 150))]
        a = rng.randrange(len(page) - 12)
        quote = page[a : a + 12]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(quote))
            quote = rng.choice([quote[:k] + quote[k + 1 :], [*quote[:k], "zzzz", *quote[k:]], [*quote[:k], quote[k] + "x", *quote[k + 1 :]]])
        quote, page = list(map(H.form, quote)), list(map(H.form, page))
        places = {}
        for j, w in enumerate(page):
            places.setdefault(w, []).append(j)
        whole, got = H.align(quote, page, -len(quote), len(page)), H.located(quote, page, places)
        assert got is None and whole[0] < H.LEAST * H.SAME * len(quote) or got and got[0] <= whole[0]
        same += got == whole or got is None
        assert got is None or abs(got[1] - a) <= 3
    assert same >= 147


def boxes_of(page, words):
    return [(page, k, w, k % 10 * 50.0, k // 10 * 12.0, k % 10 * 50.0 + 5 * len(w), k // 10 * 12.0 + 10) for k, w in enumerate(words)]


def test_unions_of_boxes_through_spark(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 2)
    text = "El presupuesto de la obra incluye tabiques de yeso laminado con espesor de quince milimetros y perfiles de acero segun norma vigente".split()
    rows = boxes_of(1, text) + [(2, 0, "tabiques", None, 0.0, 1.0, 1.0), (2, 1, None, 0.0, 0.0, 1.0, 1.0), (2, 2, "yeso", 3.0, 4.0, 5.0, 6.0), (None, 0, "yeso", 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "page long, place int, word string, x0 double, y0 double, x1 double, y1 double")
    quotes = [(10, 1, "tab1ques de yes0 lam1nado, con espesor"), (11, 1, "perfi1es de acero"), (12, 1, "nada de esto esta aqui escrito"), (13, 1, None), (14, 1, ""), (15, None, "yeso"), (16, 2, "yeso"), (17, 9, "yeso"), (18, 1, "presupuesto de obra incluye"), (19, 1, "tabiques")]
    got = {r.quote: r for r in H.highlights(spark.createDataFrame(quotes, "quote long, page long, text string"), boxes).collect()}
    assert set(got) == {10, 11, 16, 18, 19}
    r = got[10]
    assert (r.first, r.last, r.x0, r.y0, r.x1, r.y1) == (6, 11, 0.0, 0.0, 450.0 + 40, 22.0)
    assert (got[11].first, got[11].last) == (16, 18) and (got[18].first, got[18].last) == (1, 5) and (got[16].x0, got[16].y1) == (3.0, 6.0)
    assert H.highlights(spark.createDataFrame([], "quote long, page long, text string"), boxes).count() == 0
