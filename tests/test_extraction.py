"""Extractors, chunks, threads and rules on papers by hand."""

from pyspark.sql import functions as F

from lectern.operators import chunking, corpus, extraction, records, retrieval


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_tables_are_cut_and_filled(spark):
    t = "x\n| Ref | Concepto | Cant | Total |\n|---|:---|---:|---|\n| a | uno | 2 | 1.234,5 |\n| b |\n| | | | |\n| c | tres | x | 5 | extra |\nTOTAL fuera\n| d | no | 1 | 1 |"
    got = [(r.item, r.reference, r.description, r.quantity, r.total_price) for r in extraction.items(one(spark, t), "id").orderBy("item").collect()]
    assert got == [(0, "a", "uno", 2.0, 1234.5), (1, "b", None, None, None), (2, "c", "tres", None, None)]
    total = "| Concepto | Total |\n| -- | -- |\n| uno | 7 |\n| TOTAL | 5 |"
    assert extraction.table_total(one(spark, total), "id").first().total == 5.0
    assert extraction.items(one(spark, None), "id").count() == 0 and extraction.items(one(spark, "| a |\nno rule"), "id").count() == 0


def test_work_items_carry_their_chapter(spark):
    t = "0.1 m2 suelto 1 2 2\n1 Obra\n1.1 m2 Muro 2,5 1.000,00 2.500,00\ntexto\n1.2.1 ud Puerta 2x1 1 10 10\n2 Pintura\n2.1 kg x 1 1 1"
    got = [(r.code, r.parent, r.chapter, r.quantity, r.total) for r in extraction.work_items(one(spark, t), "id").orderBy("code").collect()]
    assert got == [("0.1", "0", None, 1.0, 2.0), ("1.1", "1", "Obra", 2.5, 2500.0), ("1.2.1", "1.2", "Obra", 1.0, 10.0), ("2.1", "2", "Pintura", 1.0, 1.0)]


def test_sections_and_empty_texts(spark):
    got = [(r.code, r.path, r.body) for r in extraction.sections(one(spark, "nada\n1 Uno\na\n1.1 Dos\n1.1.1 Tres\nb\nc"), "id").orderBy("code").collect()]
    assert got == [("1", "Uno", "a"), ("1.1", "Uno → Dos", ""), ("1.1.1", "Uno → Dos → Tres", "b\nc")]
    assert extraction.sections(one(spark, None), "id").count() == 0 and extraction.sections(one(spark, "x"), "id").count() == 0


def test_mail_fields(spark):
    t = "From: A <A@X.com>, b@y.org\nSubject: RV: re: Urgente\nDate: x\n\nFrom: no\nAttachments:\n- a.pdf\n- A.PDF\n"
    r = extraction.mail_fields(one(spark, t), "id").withColumn("a", extraction.addresses("sender")).first()
    assert r.a == ["a@x.com", "b@y.org"] and r.subject_key == "urgente" and r.is_issue and r.attachments == "a.pdf" and r.message_id is None
    assert extraction.mail_fields(one(spark, None), "id").first().sender is None


def test_chunks_keep_tables_and_headings():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {k} | x |" for k in range(300))
    got = list(chunking.structured(f"# Uno\n\nTexto corto.\n\n{table}\n\nMás texto.\n\nFINAL DE TODO"))
    assert [k for _, k in got] == ["text", "table", "text", "heading"] and got[1][0] == f"# Uno\n{table}" and got[0][0] == "# Uno\nTexto corto."
    assert list(chunking.structured("")) == [] and [k for _, k in chunking.structured("a  b\nc  d\n")] == ["table"] and [k for _, k in chunking.structured("solo  una")] == ["text"]
    long = " ".join(f"Palabra{k} dos tres." for k in range(200))
    parts = [c for c, _ in chunking.structured("Alcance:\n" + long)]
    assert len(parts) > 2 and all(c.startswith("Alcance:\n") and len(c.split()) <= 221 for c in parts)
    assert {w for c in parts for w in c.split()} == {"Alcance:", *long.split()}


def test_html_to_markdown(spark):
    html = "<html><head><title>t</title></head><body><script>x<y</script><h2>Uno</h2><p>a <b>b</b> &amp; <em>c</em></p><ul><li>d</li><li>e</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert one(spark, html).select(extraction.html_markdown(F.col("text"))).first()[0] == "# Uno\n\na **b** & *c*\n\n- d\n- e\n\n| x | y |\n| 1 | 2 |"


def test_headers_and_filters(spark):
    d = spark.createDataFrame([("a|b", None, 3), (None, None, None)], "k string, f string, p int")
    assert [r[0] for r in d.select(extraction.metadata_header(F.col("k"), F.col("f"), F.col("p"))).collect()] == ["[tipo=ab | pág=3]", ""]
    assert records.money_filters("facturas de menos de 1.000 en enero de 2020 sin aceptar") == {"max_total": 1000.0, "year": 2020, "month": 1, "accepted": False}
    assert corpus.normalised({"extension": "PDF", "ids": [3, 1, 3], "x": 1, "text": ""}) == {"extension": ".pdf", "ids": [1, 3]}
    assert spark.createDataFrame([("a%_\\",)], "x string").select(corpus.like_escaped(F.col("x"))).first()[0] == "a\\%\\_\\\\"
    assert corpus.glob_pattern("a*b?.c") == "^a.*b.\\.c$"


def test_visibility_rules(spark):
    rows = [(1, True, "en", "assigned", 1, 1, []), (2, False, "fr", "assigned", 1, 1, []), (3, False, "en", None, 1, 1, []), (4, False, "en", "assigned", 1, 1, ["CONFIDENTIAL"]), (5, False, "en", "quarantine", 9, 9, []), (6, False, "en", "assigned", 9, 1, []), (7, False, "en", "assigned", 2, 9, []), (8, False, "en", "assigned", None, None, None)]
    d = spark.createDataFrame(rows, "id int, deleted boolean, type string, assignment string, chain int, hotel int, tags array<string>")
    why = lambda s: [r[0] for r in d.select(corpus.reason(s)).collect()]
    assert why({**corpus.SCOPE, "allow_unassigned": False}) == ["denied: deleted", "denied: type", "denied: no metadata", "denied: tag", "denied: not assigned", "allowed: hotel", "allowed: chain", "denied: outside"]
    assert why({"is_admin": True})[1:] == ["allowed: administrator"] * 7 and why({})[5] == "denied: outside" and why({"all_hotels": True})[7] == "allowed: all hotels"


def test_exact_numbers_and_phrases(spark):
    d = spark.createDataFrame([("n 0026-00.25 x",), ("1260025",), ("mañana",), ("la ma, no",), (None,)], "t string")
    assert [r[0] for r in d.select(retrieval.contains_number(F.col("t"), "260025")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in d.select(retrieval.contains_phrase(F.col("t"), "MA")).collect()] == [False, False, False, True, False]
    assert [r[0] for r in spark.createDataFrame([("00-12/3",), ("000",)], "t string").select(retrieval.plain_number(F.col("t"))).collect()] == ["123", "0"]
    assert retrieval.variations("precio del 12-34/5") [0][1] == 1.0 and ("12-34/5", 0.9) in retrieval.variations("precio del pedido 12-34/5", 9)


def test_measures(spark):
    r = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, 12, 4), (2, 5, 1)], "query int, item int, rank int")
    x = spark.createDataFrame([(1, 11), (1, 99)], "query int, item int")
    got = {a.query: (a.recall, a.precision, a.n_expected) for a in retrieval.recall_at(r, x, 3).collect()}
    assert got == {1: (0.5, 0.5, 2), 2: (1.0, None, 0)}
    e = spark.createDataFrame([("abc d", "abc  d"), ("", None), ("ab", "")], "a string, b string").select(retrieval.character_error_rate("a", "b")).collect()
    assert [v[0] for v in e] == [0.0, 0.0, 1.0]


def test_set_operations_and_duplicates_with_nulls(spark, tmp_path):
    from lectern.operators import business, documents

    spark.createDataFrame([(1,), (1,), (2,), (None,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1,), (3,)], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = [(r.op, r.k) for r in business.set_ops_union_intersect_except(spark, str(tmp_path)).collect()]
    assert sorted(x for x in got if x[0] == "except" and x[1]) == [("except", 2)] and ("except", None) in got and len(got) == len(set(got))
    spark.createDataFrame([(1, None), (2, None), (3, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.duplicate_of for r in documents.exact_dedupe(spark, str(tmp_path)).collect()} == {1: None, 2: 1, 3: None}
