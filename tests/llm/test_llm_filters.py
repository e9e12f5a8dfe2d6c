import pandas as pd
import pytest

pytest.importorskip("emberwatch.llm")
import plain  # noqa: E402

from emberwatch.llm import decontaminate, language, licenses, quality, sql, url_templates  # noqa: E402

SCHEMA = plain.SCHEMA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.rows(list(range(23))), SCHEMA).cache()


def test_quality_matches_sql(spark, docs):
    got = quality.judge(docs)
    frame = docs.select("doc_id", "text").toPandas()
    assert plain.plain_rows(got.drop("rejected_by")) == plain.sql(sql.QUALITY, documents=frame)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept == {r["doc_id"]: plain.good(r["text"]) for r in docs.collect()}
    stays = quality.keep_good(docs)
    assert stays.columns == docs.columns
    assert {r["doc_id"] for r in stays.collect()} == {d for d, k in kept.items() if k}


def test_quality_counts_words_between_any_blanks(spark):
    body = " ".join(f"w{k}" for k in range(30))
    ends = [*plain.BLANKS, *"tnfrxu0bc\\", "f\f", "\ff", "\x1c", "\x85"]
    texts = [f"{a}{body}{b}" for a in ends for b in ends]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        words = plain.WORD.findall(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words))), repr(texts[r["doc_id"]])


def test_quality_edges(spark):
    odd = spark.createDataFrame(plain.rows([None, None, 3, 3]), SCHEMA)
    assert quality.judge(odd).count() == 4
    assert quality.judge(odd.limit(0)).count() == 0


def test_rule_order_follows_rejections_per_cost(spark):
    good = [(k, plain.paragraph(k)) for k in range(10)]
    stutter = [(100 + k, " ".join("abcdefghij"[k] + "qrst"[i % 4] + "klmnopuvwx"[i // 4] for i in range(40) for _ in range(4))) for k in range(10)]
    order = quality.plan_rules(spark.createDataFrame(good + stutter, "doc_id long, text string"))
    assert order[0]["rule"].name == "stuttering" and order[0]["rejected"] == 10
    assert {s["rule"].name for s in order} == {r.name for r in quality.RULES}


def pages():
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/1", "http://example.org/en/2/"]
    urls += ["http://x.com/fr/", "http://x.com/de/a", "http://xcom/de/a", "http://org?q=/", "http://deep.net/a/b/c/d/e#f"]
    urls += [f"http://bad.net/en/{k}.html" for k in range(40)] + [f"http://fine.net/{'en' if k % 2 else 'fr'}/{k}" for k in range(40, 80)]
    urls += [f"http://mixed.net/good/{k}" for k in range(80, 110)] + [f"http://mixed.net/evil/{k}" for k in range(110, 140)]
    urls += [f"http://names.net/{'abcdefghijkl'[k]}{'mnopqrstuvwx'[k]}/z" for k in range(12)]
    return pd.DataFrame({"page_id": [*range(len(urls)), None], "url": [*urls, urls[-1]], "host": "clash", "rule": "clash"})


def test_urls_match_sql(spark):
    frame = pages()
    frame["page_id"] = frame["page_id"].astype("Int64")
    labels = pd.DataFrame({"doc_id": range(140), "quality": [int(not (k < 40 or 110 <= k < 140)) for k in range(140)]})
    given = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "page_id long, url string, host string, rule string")
    labelled = url_templates.page_labels(given, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = url_templates.judge_urls(given, labelled)
    assert plain.plain_rows(got) == plain.sql(sql.URLS, pages=frame[["page_id", "url"]], labels=labels)
    found = {r["page_id"]: r for r in got.collect()}
    assert found[4]["rule"] == "example.org/es/" and found[4]["host"] == "a.example.org" and found[4]["verdict"] == "block"
    assert found[10]["rule"] is None and found[9]["rule"] is None and found[5]["rule"] == "example.org/en/1"
    verdict = {h: {r["verdict"] for r in found.values() if r["host"] == h} for h in ("bad.net", "fine.net", "mixed.net")}
    assert verdict == {"bad.net": {"block"}, "fine.net": {"allow"}, "mixed.net": {"allow", "block"}}


def test_listed_rules_have_the_verdict_of_the_contract(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = [(k, f"http://sub.{rule}23") for k, rule in enumerate(rules)]
    given = spark.createDataFrame(rows, "page_id long, url string")
    good = given.selectExpr("url", "url LIKE '%.example.org/%' OR url LIKE '%.com/de/%' AS good")
    got = url_templates.judge_urls(given, good)
    assert {r["rule"]: r["verdict"] for r in got.collect()} == rules
    frame, labels = pd.DataFrame(rows, columns=["page_id", "url"]), pd.DataFrame({"doc_id": [123], "quality": [1]})
    assert plain.sql(sql.URLS, pages=frame, labels=labels) == plain.plain_rows(url_templates.judge_urls(given, url_templates.page_labels(given, spark.createDataFrame(labels))))


def test_urls_without_labels(spark):
    given = spark.createDataFrame([(1, "http://a.net/b"), (1, "http://a.net/b")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good boolean")
    assert [r["verdict"] for r in url_templates.judge_urls(given, none).collect()] == ["allow", "allow"]
    assert url_templates.judge_urls(given.limit(0), none).count() == 0


def test_leaks_match_plain_alignment(spark, docs):
    item = "which of the seven bridges did the old mathematician cross twice before he wrote down his famous proof"
    words = item.split()
    edited = " ".join("altered" if k in (3, 11) else w for k, w in enumerate(words) if k != 7)
    items = {1: item, 2: "too short here", 3: plain.SENTENCES[0], 4: "", 5: "an item that no document of this table has copied at all"}
    extra = {100: f"Before it {item.upper()}! and after", 101: f"some {edited} more", 102: " ".join(words[::-1]), 103: " ".join(words[:6])}
    given = docs.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame([(d, t, "r") for d, t in extra.items()] + [(None, item, "r")], "doc_id long, text string, row string")
    )
    table = spark.createDataFrame([*items.items(), (6, None), (None, item)], "item_id long, text string")
    got = decontaminate.leaks(given, table)
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == plain.leaking(texts, items)
    assert {100, 101, None} <= {r["doc_id"] for r in got.where("item_id = 1").collect()}
    spans = got.where("doc_id = 100 AND item_id = 1").first()
    assert (spans["score"], spans["first_word"], spans["past_word"]) == (1.0, 2, 2 + len(words))
    left = decontaminate.drop_leaks(given, table.where("item_id = 1"))
    assert left.columns == given.columns and {100, 101, None} & {r["doc_id"] for r in left.collect()} == set()
    assert left.count() == given.count() - 3
    assert decontaminate.leaks(given.limit(0), table).count() == 0
    assert decontaminate.leaks(given, table.limit(0)).count() == 0


def test_leaks_by_common_passages_of_an_item(spark):
    words = [f"q{k}" for k in range(40)]
    texts = {0: "before " + " ".join(words) + " after"} | {k: f"some{k} {' '.join(words[:20])} more{k}" for k in range(1, 12)}
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(given, table).collect()}
    assert got == plain.leaking(texts, {1: " ".join(words)}) == {(k, 1) for k in range(12)}


def test_leaks_without_intact_runs(spark):
    items = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in (4, 5, 15, 16, 37, 59)}
    texts = {0: "no copy of any item"}
    for n, item in items.items():
        words = item.split()
        for every in (3, 4):
            texts[len(texts)] = "x y " + " ".join("new" if k % every == every - 1 else w for k, w in enumerate(words)) + " z"
            texts[len(texts)] = " ".join(w for k, w in enumerate(words) if k % every)
        for every in (1, 2, 3):
            texts[len(texts)] = " ".join(w + " new" * (k % every == 0) for k, w in enumerate(words))
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(given, table).collect()}
    assert got == plain.leaking(texts, items) and len(got) > 25


def test_leaks_of_repeated_and_null_ids(spark):
    copies = {n: " ".join(f"{n}{k}" for k in range(20)) for n in "abc"}
    texts = [(None, copies["a"]), (None, "clean"), (1, copies["b"]), (1, "clean too"), (2, copies["c"]), (3, None)]
    given = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(7, copies["a"]), (7, copies["b"]), (None, copies["c"])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(given, table).collect()}
    assert got == {(None, 7), (1, 7)}
    left = {(r["doc_id"], r["text"]) for r in decontaminate.drop_leaks(given, table).collect()}
    assert left == {(None, "clean"), (1, "clean too"), (3, None)}


def test_alignment_score_is_that_of_the_plain_one():
    a, b = plain.paragraph(1).split(), plain.paragraph(3).split()
    assert decontaminate.align(a, b)[0] == plain.smith_waterman(a, b)


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("any person obtaining", "every one who obtains").replace("without restriction", "freely")
    texts = [
        None, "", "Intro. Released under the MIT License. Outro", f"x {edited} y", "licensed to drive under the bridge",
        "Released under the MIT License.\n" * 2, f"{plain.paragraph(1)}\nThis work is licensed under the GNU General Public License, version 3.",
        "İ Licensed under CC BY-NC 4.0.",
    ]
    given = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, texts[2], "c")], "doc_id long, text string, license string")
    got = licenses.scan(given)
    hits = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["license"]) for r in got.collect())
    assert hits == [
        (-1, "MIT notice"), (2, "MIT notice"), (3, "MIT"), (5, "MIT notice"), (5, "MIT notice"),
        (6, "GPL-3.0 notice"), (7, "CC-BY-NC-4.0 notice"),
    ]
    span = got.where("doc_id = 2").first()
    assert texts[2][span["begin"] : span["end"]] == "Released under the MIT License" and span["coverage"] == 1.0
    assert licenses.scan(given.limit(0)).count() == 0


def test_short_notices_with_an_edit_at_every_place():
    index = licenses.Index(licenses.TEMPLATES)
    found = lambda text: [h[0] for h in licenses.find(index, text)]
    for name, template in licenses.TEMPLATES.items():
        words = licenses.tokens(template)
        assert found(f"Intro. {template} Outro") == [name] or name == "Apache-2.0 header"
        if 5 <= len(words) < licenses.SHORT:
            for k in range(len(words)):
                for edit in ([], ["edited"]):
                    text = " ".join(["x y", *words[:k], *edit, *words[k + 1 :], "z"])
                    index_of_one = licenses.Index({name: template})
                    assert [h[0] for h in licenses.find(index_of_one, text)] == [name]
                    assert found(text)
    assert found("Released under MIT License") == ["MIT notice"]


def test_license_tags():
    text = "// SPDX-License-Identifier: MIT OR Apache-2.0\n# SPDX-License-Identifier: GPL-2.0-only */"
    hits = licenses.find(licenses.Index(licenses.TEMPLATES), text)
    assert [h[:2] for h in hits] == [("SPDX MIT OR Apache-2.0", 1.0), ("SPDX GPL-2.0-only", 1.0)]
    assert text[hits[0][2] : hits[0][3]] == "SPDX-License-Identifier: MIT OR Apache-2.0"


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", table_clash())
    got = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def table_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_language_edges_and_mixtures(spark):
    given = spark.createDataFrame(
        [(k, ("uno dos tres cuatro " if k % 2 else "one two three four ") * 9, "es" if k % 2 else "en") for k in range(40)]
        + [(50, None, "en"), (51, "12 ... !", "en"), (52, "", None), (None, "one two", ""), (53, "one two " * 30 + "dos tres " * 10, None)],
        "doc_id long, text string, lang string",
    )
    found = {r["doc_id"]: r for r in language.identify(given).collect()}
    assert {found[k]["lang_pred"] for k in (50, 51, 52)} == {"und"} and found[51]["score"] == 0.0
    assert found[None]["lang_pred"] == "en" and not found[None]["held_out"]
    assert found[53]["lang_pred"] == "en" and 0.6 < found[53]["score"] < 0.9
    untaught = language.identify(given.withColumn("lang", table_clash().substr(1, 0)))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
    assert language.identify(given.limit(0)).count() == 0
