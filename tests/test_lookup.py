"""Look-ups, routes, papers and corrections by hand."""

from pyspark.sql import functions as F

from lectern.operators import business, lookup, records


def test_by_id_and_best(spark):
    r = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert sorted(map(tuple, lookup.by_id(r, spark.createDataFrame([(2,), (2,), (9,)], "asked int"), "id").collect()), key=str) == [(2, "b"), (9, None)]
    m = spark.createDataFrame([(1, 10, "text", "x"), (1, 9, "text", "budget"), (1, 8, "path", "budget"), (2, 7, "other", None)], "q int, document int, source string, type string")
    got = {a.q: a.document for a in lookup.best(m, "q", {"text": 1, "path": 2}, "budget").collect()}
    assert got == {1: 9, 2: 7}


def test_numbers_of_any_form(spark):
    b = spark.createDataFrame([(5, "PRE-1"), (3, "pre 1"), (8, "Á.9")], "id int, number string")
    got = {r.asked: r.id for r in records.by_number(b, spark.createDataFrame([("PRE-1",), ("pre/1",), ("a9",), ("zz",)], "asked string")).collect()}
    assert got == {"PRE-1": 5, "pre/1": 3, "a9": 8, "zz": None}


def test_categories_and_keywords(spark):
    d = spark.createDataFrame([("x.xls", None), ("Plano.pdf", ""), ("a", "Planes"), ("a", "Raro"), ("nada", None)], "n string, f string")
    assert [r[0] for r in d.select(lookup.category(F.col("n"), F.col("f"))).collect()] == ["pedidos", "planos", "planos", "raro", "otros"]
    t = spark.createDataFrame([("Los planos",), ("aplano",), ("PEDIDOS",), (None,)], "t string")
    assert [r[0] for r in t.select(lookup.has_keyword(F.col("t"), "plano")).collect()] == [True, False, False, False]
    q = spark.createDataFrame([("¿Cuántas facturas hay?",), ("suma",), ("",), (None,)], "t string").select(lookup.aggregation(F.col("t")).alias("a")).collect()
    assert [(r.a.entity, r.a.kind) for r in q] == [("invoice", "count"), (None, "total"), (None, None), (None, None)]


def test_orders_without_labels(spark):
    t = "PEDIDO de obra\nx\n\n12345\nUno S.L.\nDos y Cia S.A.\nImporte total 12,50\n"
    r = lookup.order_fields(spark.createDataFrame([(1, t), (2, None)], "id int, text string"), "id").collect()
    assert (r[0].number, r[0].supplier, r[0].client, r[0].total) == ("12345", "Uno S.L.", "Dos y Cia S.A.", 12.5) and r[1].number is None


def test_corrections(spark):
    t = "NIF 00000037B e IBAN ES91 2100 0418 4502 0005 1332, 1.2O4,50 el 25/03/26 y 12345678A"
    d = spark.createDataFrame([(1, t), (2, "nada 12,5"), (3, None)], "id int, text string")
    rows = lookup.postprocessed(d, "id").collect()
    assert [(r.kind, r.corrected, r.confidence) for r in rows if r.id == 1 and r.kind != "nif"] == [("iban", "ES9121000418450200051332", 1.0), ("amount", "1204.50", 1.0), ("date", "2026-03-25", 1.0)]
    by = {r.kind: r for r in rows if r.id == 1}
    assert by["iban"].corrected == "ES9121000418450200051332" and by["amount"].corrected == "1204.50" and by["date"].corrected == "2026-03-25"
    assert by["date"].text.endswith("1204.50 el 2026-03-25 y 12345678A") and [(r.id, r.kind) for r in rows if r.id > 1] == [(2, None), (3, None)]


def test_every_occurrence_is_corrected(spark):
    t = "importe 1.2O3,50 y 2.3O4,60 y 1.2O3,50; b58818501 y B58818501, b58818502; 00000035z 00000037B"
    rows = lookup.postprocessed(spark.createDataFrame([(1, t), (1, "1.2O3,50")], "id int, text string"), "id").collect()
    got = sorted((r.kind, r.original, r.corrected) for r in rows if len(r.text) > 20)
    amounts = [("amount", "1.2O3,50", "1203.50")] * 2 + [("amount", "2.3O4,60", "2304.60")]
    assert [g for g in got if g[0] == "amount"] == amounts and [g for g in got if g[0] == "cif"] == [("cif", "b58818501", "B58818501")]
    assert rows[0].text.startswith("importe 1203.50 y 2304.60 y 1203.50; B58818501 y B58818501, b58818502;") and [r.text for r in rows if len(r.text) < 20] == ["1203.50"]


def test_validation_and_relations(spark):
    e, f = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, None), (4, 1.0)], "k int, v double"), spark.createDataFrame([(1, 10.05), (2, 11.0), (3, None), (5, 1.0)], "k int, v double")
    assert {r.k: r.result for r in lookup.validated(e, f, "k", "v").collect()} == {1: "equal", 2: "different", 3: "equal", 4: "missing", 5: "unexpected"}
    m = spark.createDataFrame([(d, r) for d in range(50) for r in (0, 100 + d // 2, 200 + d // 4)] + [(None, 1), (7, None)], "doc int, ref int")
    got = {(r.a, r.b): r.shared for r in business.sharing(m).collect()}
    want = {}
    for a in range(50):
        for b in range(a + 1, 50):
            s = 1 + (a // 2 == b // 2) + (a // 4 == b // 4)
            if s >= 2:
                want[a, b] = s
    assert got == want


def test_entities(spark):
    found = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "b")], "tenant int, name string")
    known = spark.createDataFrame([(None, "a", 7)], "tenant int, name string, id long")
    got = {(r.tenant, r.name): (r.id, r.fresh) for r in records.resolved(found, known, "tenant", "name").collect()}
    assert got[None, "a"] == (7, False) and got[1, "a"][1] and got[1, "a"][0] != got[1, "b"][0] and len(got) == 3
    issues = spark.createDataFrame([("x", 1, None), ("x", 1, None), ("y", None, "i")], "kind string, budget int, invoice string")
    assert [tuple(r) for r in records.ensure_issues(issues, issues.filter("kind = 'y'")).collect()] == [("x", 1, None)]
