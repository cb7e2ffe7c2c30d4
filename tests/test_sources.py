import json

import pytest
from pyspark.sql import functions as F

from cadence.operators import evaluate
from cadence.sources import lexicon as L
from cadence.streaming import posts
from cadence.tables import SEED_LEXICON


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, value string")


def test_cmudict(spark):
    rows = ["cat K AE1 T", "fire F AY1 ER0 # note", "fire(2) F AY1 R", "only(2) OW1 N L IY0", "only(3) OW1", "it's IH1 T S", "", "  ", "mm M"]
    got = {r["word"]: (r["primary"], r["counts"]) for r in L.parse_cmudict(lines(spark, rows)).collect()}
    assert got == {"cat": (1, [1]), "fire": (2, [1, 2]), "only": (1, [1, 2]), "it's": (1, [1]), "mm": (0, [0])}


def test_wikipron(spark):
    rows = ["Cat\tk æ t", "idea\ta ɪ d i ə", "cat\tk æ t ə", "button\tb ʌ t n̩", "none", "\tx", "sh\tʃ"]
    assert {r["word"]: r["counts"] for r in L.parse_wikipron(lines(spark, rows)).collect()} == {"cat": [1, 2], "idea": [2], "button": [2]}


def test_kaikki(spark, tmp_path):
    got = {r["word"]: (r["ipa"], r["hyph"]) for r in L.parse_kaikki(lines(spark, ["a\t1,2\t3", "b", "a\t\t4", "c\t,1"])).collect()}
    assert got == {"a": ([], [4]), "b": ([], []), "c": ([1], [])}
    rows = [
        {"lang_code": "en", "word": " Cat ", "sounds": [{"ipa": "/ˈkæ.tə/"}, {"ipa": "x"}, {}], "hyphenations": [{"parts": ["ca", "t", ""]}]}, {"lang_code": "fr", "word": "chat", "hyphenation": ["chat"]},
        {"lang_code": "en", "word": "many", "hyphenations": [{"parts": list("abcdefghijklm")}]}, {"lang_code": "en", "word": "cat", "hyphenation": ["cat"]},
    ]
    path = tmp_path / "k.jsonl"
    path.write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    entries = L.read_kaikki_json(spark, str(path))
    assert {r["word"]: (r["ipa"], r["hyph"]) for r in L.extract_kaikki(entries).collect()} == {"cat": ([2], [1, 2])}
    assert entries.cache().where("_corrupt_record is not null").count() == 1
    L.write_kaikki(L.extract_kaikki(entries), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "cat\t2\t1,2"


def test_reconcile_split_and_files(spark, tmp_path):
    cmu = spark.createDataFrame([("it's", 1, [1]), ("its", 2, [2]), ("fire", 2, [1, 2])], "word string, primary int, counts array<int>")
    wiki = spark.createDataFrame([("its", [5]), ("new", [3, 2])], "word string, counts array<int>")
    kaikki = spark.createDataFrame([("fire", [], [2]), ("hy", [], [4]), ("no", [], [])], "word string, ipa array<int>, hyph array<int>")
    out = L.reconcile(cmu, wiki, kaikki)
    got = {r["word"]: (r["primary"], r["valid"], r["ambiguous"], r["source"]) for r in out.collect()}
    assert got == {"its": (1, [1, 2], True, "cmu"), "fire": (2, [1, 2], True, "cmu"), "new": (2, [2, 3], False, "wikipron"), "hy": (4, [4], False, "kaikki")}
    assert out.where("word = 'new'").select(L.soft_labels(F.col("valid")).alias("y")).first()["y"] == [0, 0.5, 0.5, 0, 0, 0, 0, 0]
    for name in ("lex.tsv.xz", "lex.parquet"):
        L.write_lexicon(out, str(tmp_path / name))
        assert {r["word"]: r["primary"] for r in L.read_lexicon(spark, str(tmp_path / name)).collect()} == {k: v[0] for k, v in got.items()}
    (tmp_path / "cmudict.dict").write_text("cat K AE1 T\nfire F AY1 ER0\nfire(2) F AY1 R\n")
    (tmp_path / "empty.tsv.xz").write_bytes(b"")
    (tmp_path / "broken.tsv.xz").write_bytes(b"no archive")
    assert L.load_lexicon(spark, str(tmp_path / "lex.tsv.xz"), "none").count() == len(got)
    for name in ("empty.tsv.xz", "broken.tsv.xz", "missing.tsv.xz", "missing.tsv", "missing.parquet"):
        found = {r["word"]: (r["primary"], r["valid"], r["ambiguous"], r["source"]) for r in L.load_lexicon(spark, str(tmp_path / name), str(tmp_path / "cmudict.dict")).collect()}
        assert found == {"cat": (1, [1], False, "cmu"), "fire": (2, [1, 2], True, "cmu")}, name
    with pytest.raises(Exception, match="missing"):
        L.load_lexicon(spark, str(tmp_path / "missing.parquet"))
    with pytest.raises(ValueError):
        L.split(out, "other")
    assert {r["word"]: r["part"] for r in L.split(out, "source_oov").collect()}["new"] == "test"
    words = spark.range(4000).select(F.concat(F.lit("run"), F.conv(F.col("id").cast("string"), 10, 26), F.when(F.col("id") % 2 == 0, "ing").otherwise("")).alias("word"), F.lit("cmu").alias("source"))
    parts = L.split(words, "hard").withColumn("stem", L.stem(F.col("word")))
    assert parts.groupBy("stem").agg(F.countDistinct("part").alias("n")).where("n > 1").count() <= 2  # those at a part's end
    for how in ("hard", "random"):
        assert {r["part"]: r["count"] for r in L.split(words, how, 7, 0.03, 0.111).groupBy("part").count().collect()} == {"test": 444, "val": 120, "train": 3436}
    mixed = words.withColumn("source", F.when(F.col("word").contains("A"), "wikipron").otherwise("cmu"))
    n = mixed.where("source = 'wikipron'").count()
    got = L.split(mixed, "source_oov", 1, 0.05)
    assert {(r["part"], r["source"]): r["count"] for r in got.groupBy("part", "source").count().collect()} == {("test", "wikipron"): n, ("val", "cmu"): 200, ("train", "cmu"): 3800 - n}
    assert {r["part"] for r in L.split(words, "all").select("part").distinct().collect()} == {"train"}
    few = words.limit(7)
    assert {r["part"]: r["count"] for r in L.split(few, "random", 0, 0.2, 0.3).groupBy("part").count().collect()} == {"test": 2, "val": 1, "train": 4}


def test_stem(spark):
    words = {"running": "runn", "happiness": "happ", "cities": "cit", "bed": "bed", "boxes": "box", "nations": "nation", "nation": "nation"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", L.stem(F.col("w")).alias("s")).collect()} == words


def test_measures(spark):
    rows = [([0.7, 0.25, 0.05], 1, [1, 2], True), ([0.1, 0.2, 0.7], 2, [2], False), ([0.2, 0.3, 0.5], 3, [1, 3], True)]
    df = spark.createDataFrame(rows, "p array<double>, y int, valid array<int>, ambiguous boolean")
    m = evaluate.metrics(df).first()
    assert (round(m["exact"], 3), m["within1"], round(m["mae"], 3), round(m["lenient"], 3), m["amb_cover"], m["amb_n"], m["tail"]) == (0.667, 1.0, 0.333, 0.667, 1.0, 2, None)
    assert m["amb_mass"] == pytest.approx((0.95 + 0.7) / 2)
    assert evaluate.metrics(df.where("not ambiguous")).first()["amb_cover"] is None
    assert [(t["count"], t["p"]) for t in df.limit(1).select(evaluate.top_classes(F.col("p"), 2).alias("t")).first()["t"]] == [(1, 0.7), (2, 0.25)]
    results = spark.createDataFrame([("a", 0.9, 10), ("b", 0.95, 30), ("c", 0.95, 20), ("d", None, 40)], "run string, best_val double, params int")
    assert evaluate.best_run(results, size="params").first()["run"] == "c" and [r["run"] for r in evaluate.by_size(results).collect()] == ["d", "b", "c", "a"]
    runs = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.55), ("a", 4, 0.6)], "run string, epoch int, v double")
    assert [r["stop"] for r in evaluate.early_stop(runs, "run", "epoch", "v", 2).orderBy("epoch").collect()] == [False, False, False, True]


def test_events(spark, tmp_path):
    path = str(tmp_path / "log")
    for e in ("val", "result"):
        L.append_events(spark.createDataFrame([(e, 1.0)], "event string, exact double"), path)
    assert L.read_events(spark, path, "val").count() == 1 and L.read_events(spark, path).count() == 2


def test_post_stream(spark, tmp_path):
    post = lambda **k: {"action": "create", "path": posts.POST_TYPE + "/1", "record": {"type": posts.POST_TYPE, "text": "five cats in the house", "langs": ["en"], "reply": None} | k}
    rows = [post(), post(langs=["en-US"]), post(langs=["fr"]), post(langs=[]), post(text="  "), post(reply="x"), post(type="like"), post() | {"action": "delete"}, post(text="lol")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = posts.english_posts(posts.created(posts.read_posts(spark, str(tmp_path / "in"))))
    counted = stream.withColumn("syllable_count", posts.sure_count(F.col("text"), SEED_LEXICON, 7))
    query = posts.counters(counted).writeStream.outputMode("complete").format("memory").queryName("seen_posts").trigger(availableNow=True).start()
    posts.run_for(query, 60)
    assert tuple(spark.table("seen_posts").first()) == (3, 2)
    out = []
    query = counted.writeStream.foreachBatch(posts.every_nth_miss(out.extend, 1)).trigger(availableNow=True).start()
    posts.run_for(query, 60)
    assert sorted(out) == ["five cats in the house"] * 2 + ["lol"]


def test_samples_and_limits(spark, tmp_path):
    rows = [("five cats", 5) if k % 10 == 3 else (f"miss {k}", None if k % 2 else 2) for k in range(100)]
    out = []
    emit = posts.every_nth_miss(out.extend, 25)
    for lo in range(0, 100, 20):
        emit(spark.createDataFrame(rows[lo : lo + 20], "text string, syllable_count int").repartition(1), 0)
    misses = [t for t, n in rows if n != 5]
    assert sorted(x for x in out if x.startswith("miss")) == sorted(misses[24::25]) and out.count("five cats") == 10
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"action": "create", "path": str(i)}) for i in range(10)))
    seen = []
    first = posts.FirstRows(lambda batch, _: seen.append(batch.count()), 25)
    query = posts.read_posts(spark, str(tmp_path), 1).writeStream.foreachBatch(first).start()
    posts.run_for(query, 60, first.done)
    assert sum(seen) == 25 and first.done() and not query.isActive
    with pytest.raises(ImportError, match="read_posts"):
        posts.live_client("no_such_client_here")


def test_a_split_makes_its_lexicon_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    words = spark.range(0, 2000, 1, 4).select(F.concat(F.lit("w"), "id").alias("word"), F.lit("cmu").alias("source")).mapInArrow(count, "word string, source string")
    parts = {r["part"]: r["count"] for r in L.split(words, "hard").groupBy("part").count().collect()}
    assert parts == {"train": 1800, "val": 100, "test": 100} and made.value == 2000


def test_phones_of_a_word_are_read_once(spark):
    runs = spark.createDataFrame([("b ə i t ə",)], "ipa string").select(L.ipa_runs(F.col("ipa")).alias("n"))
    assert runs.first()["n"] == 2
    assert runs._jdf.queryExecution().analyzed().toString().count("split(") == 1
