from kategora.llm import language_id as li

EN = "the thing that was there with the other people who have been thinking about this and that for some time"
DE = "der hund und die katze sind nicht immer gute freunde aber sie schlafen oft zusammen auf dem sofa im zimmer"
FR = "le chat et le chien ne sont pas toujours de bons amis mais ils dorment souvent ensemble sur le canapé du salon"


def fitted(docs_of):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 3)]
    return li.fit_languages(docs_of(*rows, (90, "weird", None), (91, None, "xx"), (92, "123", "yy")))


def test_languages_and_mixtures(docs_of):
    model = fitted(docs_of)
    assert model.languages == ["de", "en", "fr"]
    docs = docs_of((1, EN[:60]), (2, DE[:60]), (3, FR[:60]), (4, f"{EN} {EN} {DE}"), (5, None), (6, ""), (7, "12 34 !"), (None, EN), (1, EN[:60]))
    rows = li.predict_languages(docs, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 4, None)] == ["en", "de", "fr", "en", "en"]
    assert set(by[4]["shares"]) == {"en", "de"} and 0.5 < by[4]["score"] < 0.9
    assert abs(sum(by[4]["shares"].values()) - 1) < 1e-6
    assert len(by[1]["shares"]) == 1 and by[1]["score"] == 1
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (5, 6, 7)] == [("und", 0.0)] * 3


def test_edges_and_empty(edges, docs_of):
    model = fitted(docs_of)
    assert li.predict_languages(edges, model).count() == edges.count()
    assert li.predict_languages(docs_of(), model).count() == 0
    none = li.fit_languages(docs_of())
    assert none.languages == []
    assert {r["lang_pred"] for r in li.predict_languages(edges, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.fit_languages(docs.filter(~li.held_out()))
    found = li.predict_languages(docs, model).filter(li.held_out()).join(docs.select("doc_id", "lang"), "doc_id")
    right, total = found.filter("lang = lang_pred").count(), found.count()
    assert total > 40 and right / total >= 0.97
