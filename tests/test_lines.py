import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.operators import evaluate, policy, resolve, scalar, scan, scorer, tokens
from cadence.operators.scalar import count_text, trace_text
from cadence.plans import api
from cadence.queries import QUERIES
from cadence.tables import SEED_LEXICON as LEXICON

TOTALS = {
    "the quick brown fox": 4, "5 cats": 2, "$19.99": 9, "3.14%": 6, "bussin": 2, "idk": 3, "in 1999": 6, "xkcd": 4, "well-known": 2, "@bob_smith": 3, "#ThrowbackThursday": 4, "w/o": 2, "b/c": 2, "IBM": 3, "NDA": 3, "STOP": 1, "NASA": 2,
    "e.g.": 2, "café": 2, "½": 2, "MIX": 1, "World War II": 3, "Henry VIII": 3, "Star Wars IV": 3, "Final Fantasy VII": 7, "lol": None, "zyqof": None, "Super Bowl LVIII": None, "section XV": None, "dont": 1, "ive": 1, "thats": 1, "doesnt": 2,
    "I’m": 1, "wouldn't": 2, "hi <3 xD :) T_T :-( </3": 1, "ebay.com": 4, "check ebay.com please": 6, "https://www.example.com": None, "nine cats": 2, "": 0, "  \n": 0, "#日本": 0, "@日本": 1, "3:0": 1, "1999, yes": None, "5/17/2026": 9, "13/13/2026": 11,
}
LINES = [*TOTALS, "you have 7 dogs, or $19.99 more, lol", "sooooo bussin this time fr 🔥😭", "on 5/17/2026 by 10:45pm, ½ is done", "mail a.b@x.io or bit.ly/abc now", "#3 and #3rd and 3-2 and 3/4 555-1234 10:45 a man", "The cat. A dog!", "x" * 5000, "@ebay.com end.no way", "13/13/2026 25:00 2/0"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")


def test_totals_of_single_texts():
    assert {t: count_text(t, LEXICON) for t in TOTALS} == TOTALS
    assert sum(r[1] for r in trace_text("https://www.example.com", LEXICON)) == 15


def test_the_plan_equals_the_scalar_reading(spark):
    traced = {}
    for r in api.trace(frame(spark, LINES)).collect():
        traced.setdefault(r["line_id"], []).append((r["pos"], r["raw"], r["n"], r["source"], r["confidence"], r["note"]))
    for k, text in enumerate(LINES):
        assert [x[1:] for x in sorted(traced.get(k, []))] == trace_text(text, LEXICON), text
    assert {r["text"]: r["syllable_count"] for r in api.count_lines(frame(spark, LINES)).collect()} == {t: count_text(t, LEXICON) for t in LINES}


def test_a_lexicon_too_large_to_send_along_gives_the_same(spark, monkeypatch):
    known = resolve.seed_lexicon(spark)
    want = sorted((r["line_id"], r["syllable_count"]) for r in api.count_lines(frame(spark, LINES), known).collect())
    monkeypatch.setattr(resolve, "BROADCAST_BYTES", 10)
    assert sorted((r["line_id"], r["syllable_count"]) for r in api.count_lines(frame(spark, LINES), known).collect()) == want
    assert want == sorted((k, count_text(t, LEXICON)) for k, t in enumerate(LINES))


def test_analyze_keeps_lines_and_their_verdict(spark):
    rows = {r["line_id"]: (r["total"], r["confident"], r["n_uncertain"]) for r in api.analyze(frame(spark, ["https://x.com/y z", "", "lol cat", None])).collect()}
    assert rows == {0: (4, True, 0), 1: (0, True, 0), 2: (1, False, 1), 3: (0, True, 0)}


def test_scorer_scatters_back_and_budgets(spark):
    lines = ["the quick qwertzuiop", "omg blarghhhh today", "a cat", "zyqof zyqof", "lol zyqof", None]
    make = scorer.peaked({"qwertzuiop": 2, "blargh": 2, "zyqof": 3})
    got = lambda **k: [r["syllable_count"] for r in api.count_lines(frame(spark, lines), scorer=make(spark), **k).orderBy("line_id").collect()]
    assert got() == [4, 7, 2, 6, None, None]
    assert got(most=5) == [4, None, 2, None, None, None]
    assert [r["syllable_count"] for r in api.count_lines(frame(spark, lines)).orderBy("line_id").collect()] == [None, None, 2, None, None, None]
    # the scorer is not asked for a line that breaks the budget without it
    asked = []

    def spy(words):
        asked.append(sorted(r["word"] for r in words.collect()))
        return make(spark)(words)

    api.count_lines(frame(spark, lines), scorer=spy, most=4).collect()
    assert asked == [["qwertzuiop", "zyqof"]]


def test_haiku_and_sweep(spark):
    df = frame(spark, ["five cats in the house", "five cats in the house and home now", "nine cats", "five cats in the new house"])
    assert [r["syllable_count"] for r in api.haiku_lines(df).orderBy("line_id").collect()] == [5, None, None, None]
    unsure = lambda words: words.select("word", F.array(*map(F.lit, [0.5, 0.3, 0.1, 0.05, 0.05, 0.0, 0.0, 0.0])).alias("p"))
    rows = api.fuzziness_sweep(frame(spark, ["zyqof"]), unsure).collect()
    assert {r["fuzziness"]: r["syllable_count"] for r in rows} == {0.0: None, 0.25: None, 0.5: 1 if 0.5 >= 0.425 and 0.2 >= 0.175 else None, 0.75: 1, 1.0: 1}


def test_gate(spark):
    rows = [([0.03, 0.9, *[0.01] * 3, *[0.013] * 3], 0.0, 2), ([0.30, 0.28] + [0.07] * 6, 0.0, None), ([0.30, 0.28] + [0.07] * 6, 1.0, 1), ([0.4, 0.4] + [0.0] * 6, 1.0, 2), ([0.4, 0.4] + [0.0] * 6, 5.0, 2), ([0.9] + [0.0] * 7, -1.0, 1)]
    df = spark.createDataFrame(rows, "p array<double>, f double, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", policy.gate(F.col("p"), F.col("f"))).collect())


def test_spelling_distances_by_hand(spark):
    known = ["abcd", "abdc", "acbd", "bacd", "abcde", "abxd", "abcdefgh", "badcefgh", "abcdefhg", "bacdefgh", "xbcdefgh"]
    pairs = [(a, b) for a in known for b in known if a != b]

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if 0 in (i, j)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for word in known:
        near = {b: distance(word, b) for a, b in pairs if a == word and (a[0] == b[0] or a[:2] == b[1::-1])}
        near = {b: n for b, n in near.items() if n <= (2 if len(word) >= 8 else 1)}
        best = [b for b, n in near.items() if n == min(near.values())]
        others = spark.createDataFrame([(b, 1) for b in known if b != word], "word string, primary int")
        got = [(r["corrected"], r["distance"]) for r in resolve.correct(spark.createDataFrame([(word,)], "word string"), others).collect()]
        assert got == ([(best[0], near[best[0]])] if len(best) == 1 else []), word


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ["definately", "teh", "borwn", "ca", "brwon", "xrown", "definitely", None]], "word string")
    known = spark.createDataFrame([(w, 1) for w in ["definitely", "brown", "born", "the", "crown", "bown"]], "word string, primary int")
    assert {r["word"]: (r["corrected"], r["distance"]) for r in resolve.correct(words, known).collect()} == {"definately": ("definitely", 1), "brwon": ("brown", 1)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab W.c'-@#/:3 19é$%’\n😂", max_size=24))
def test_scanning_never_fails_and_marks_change_nothing(text):
    tokens = scan.scan(text, LEXICON.__contains__)
    assert all(t[0] for t in tokens)
    assert count_text(text.replace("'", "’"), LEXICON) == count_text(text, LEXICON)
    assert count_text(text + " 😂", LEXICON) == count_text(text, LEXICON)


def test_repartitioning_changes_nothing(spark):
    df = frame(spark, LINES)
    key = lambda d: sorted((r["line_id"], r["syllable_count"]) for r in d.collect())
    assert key(api.count_lines(df.repartition(7))) == key(api.count_lines(df.coalesce(1)))


def test_model_weights(spark, tmp_path):
    weights = scorer.random_weights(3)
    path = str(tmp_path / "model.npz")
    scorer.save_weights(path, weights)
    assert sum(w.size for w in weights.values()) == 7372
    words = spark.createDataFrame([("cat",), ("banana",), ("日本",), ("",)], "word string")
    got = {r["word"]: r["p"] for r in scorer.npz_scorer(path)(words).collect()}
    assert got["日本"] is None and got[""] is None and abs(sum(got["cat"]) - 1) < 1e-6 and got["cat"] != got["banana"]
    assert scorer.forward(scorer.encode(["cat"]), weights)[0].tolist() == pytest.approx(got["cat"])
    raw = {r["word"]: r["p"] for r in scorer.model_scorer(weights, raw=True)(words).collect()}
    assert np.exp(raw["cat"]) / np.exp(raw["cat"]).sum() == pytest.approx(got["cat"])
    scorer.ALPHABET, kept = "zyx", scorer.ALPHABET
    try:
        with pytest.raises(ValueError):
            scorer.load_weights(path)
    finally:
        scorer.ALPHABET = kept


def by_hand(word, w):
    """The network letter by letter and unit by unit."""
    dot = lambda a, m, k: sum(x * m[i][k] for i, x in enumerate(a))
    letters = [ord(c) - 96 for c in word.lower() if "a" <= c <= "z"][:24]
    e = [w["emb"][c] for c in letters]
    zero = [0.0] * len(w["emb"][0])
    # positions behind the word are padding: they are seen by the convolution, and by nothing after it
    at = lambda i: e[i] if 0 <= i < len(e) else zero
    x = []
    for i in range(len(e)):
        row = []
        for width in (2, 3):
            k, b = w[f"convs.{width}.w"], w[f"convs.{width}.b"]
            row += [max(0.0, b[f] + sum(at(i + j - (width - 1) // 2)[d] * k[j][d][f] for j in range(width) for d in range(len(zero)))) for f in range(len(b))]
        x.append(row)
    sig = lambda v: 1 / (1 + math.exp(-v))

    def recur(rows, side):
        u, v, b, h = w[f"{side}.U"], w[f"{side}.W"], w[f"{side}.b"], list(w[f"{side}.h0"])
        out = []
        for r in rows:
            n = len(h)
            z = [sig(dot(r, v, k) + dot(h, u, k) + b[k]) for k in range(n)]
            reset = [sig(dot(r, v, k) + dot(h, u, k) + b[k]) for k in range(n, 2 * n)]
            new = [math.tanh(dot(r, v, 2 * n + k) + reset[k] * dot(h, u, 2 * n + k) + b[2 * n + k]) for k in range(n)]
            h = [(1 - z[k]) * new[k] + z[k] * h[k] for k in range(n)]
            out.append(h)
        return out

    both = [f + g for f, g in zip(recur(x, "gru_f"), recur(x[::-1], "gru_b")[::-1])]
    mean = [sum(r[k] for r in both) / len(both) for k in range(len(both[0]))]
    hidden = [max(0.0, dot(mean, w["W1"], k) + w["b1"][k]) for k in range(len(w["b1"]))]
    return [dot(hidden, w["W2"], k) + w["b2"][k] for k in range(8)]


def test_the_network_by_hand():
    r = np.random.default_rng(8)
    w = {n: (0.5 * r.standard_normal(s)) for n, s in scorer.shapes(emb=3, filters=4, gru=3, head=5)}
    for word in ("cat", "a", "It's", "zyx" * 11):
        assert scorer.logits(scorer.encode([word]), w)[0] == pytest.approx(by_hand(word, w), abs=1e-9)


def test_published_capacities_and_files(tmp_path):
    sizes = {name: sum(int(np.prod(s)) for _, s in scorer.shapes(*c)) for name, c in evaluate.CAPACITY.items()}
    assert {k: sizes[k] for k in ("s44k", "s22k", "s7k", "s4k", "s2k")} == {"s44k": 43920, "s22k": 21528, "s7k": 7372, "s4k": 4382, "s2k": 2176}
    assert sizes["small"] == sizes["s44k"] < sizes["medium"] and {c for c, _ in evaluate.RUNS.values()} <= set(sizes)
    # a file as others write it: nested keys as paths, capacities by their long names, those of the greater model by default
    path, shapes = str(tmp_path / "other.npz"), scorer.shapes(24, (2, 3), 32, 48, 64)
    paths = ["['W1']", "['W2']", "['b1']", "['b2']", "['convs'][2]['b']", "['convs'][2]['w']", "['convs'][3]['b']", "['convs'][3]['w']", "['emb']", *(f"['gru_{s}']['{k}']" for s in "bf" for k in ("U", "W", "b", "h0"))]
    meta = {"format_version": 1, "alphabet": scorer.ALPHABET, "num_classes": 8, "max_len": 24, "caps": {"embed_dim": 24, "conv_widths": [2, 3]}, "param_paths": paths, "param_shapes": [list(s) for _, s in shapes], "provenance": {}}
    arrays = {f"p{k}": np.full(s, k, np.float32) for k, (_, s) in enumerate(shapes)}
    np.savez(path, meta=np.array(json.dumps(meta)), **arrays)
    got = scorer.load_weights(path)
    assert got["emb"].shape == (27, 24) and (got["gru_f.h0"] == 16).all()
    for change in ({"param_paths": paths[::-1]}, {"caps": {"emb": 3}}, {"caps": {"embed_dim": 23}}, {"max_len": 9}):
        np.savez(path, meta=np.array(json.dumps(meta | change)), **arrays)
        with pytest.raises(ValueError):
            scorer.load_weights(path)
    with pytest.raises(ValueError):
        evaluate.check_run(True, "all")
    evaluate.check_run(True, "hard")
    evaluate.check_run(False, "all")


def test_registered_functions(spark):
    api.register(spark)
    assert spark.sql("select syllable_count('nine cats') as n, syllable_count('lol') as m").first() == (2, None)
    assert [r["n"] for r in spark.sql("select * from syllable_trace('nine cats!')").collect()] == [1, 1, 0]


def test_description(spark):
    text = api.describe(frame(spark, ["5 cats!"])).first()["description"]
    assert text.splitlines()[:2] == ["'5 cats!'", "[OK    ] total=2"] and len(text.splitlines()) == 4


def test_words_are_answered_alike_once_or_again(monkeypatch):
    r = random.Random(4)
    bits = ["don't", "xD", "XXD", "IV", "MMXX", "well-known", "www", "www.", "N’a", "été", "Straße", "ŉ", "x-D", "soooo", "hmm", "...", "中文", "n\u0303o", "it's-a", "bcdfghjkl", "eauêlemention", "hAHahAha", "cats", "3pm", "a@b.com"]
    lines = ["".join(r.choice(bits) + r.choice([" ", "", ",", ". "]) for _ in range(r.randrange(1, 7))) for _ in range(3000)]
    sums, traces = {}, {}
    for line in lines:
        assert scalar.line_sums(line, LEXICON, sums) == scalar.line_sums(line, LEXICON), line
        assert scalar.trace_text(line, LEXICON, traces) == scalar.trace_text(line, LEXICON), line
    seen = []
    monkeypatch.setattr(scalar, "scan", lambda text, known: seen.append(text) or scan.scan(text, known))
    memo = {}
    for _ in range(50):
        scalar.line_sums("été eauêlemention cats, " * 20, LEXICON, memo)
    assert len(seen) <= 4


def test_tokens_are_made_of_few_texts_at_a_time(monkeypatch):
    texts = pa.array(["é" * 40, None, "", "x" * 1000] * 100)
    monkeypatch.setattr(tokens, "LETTERS", 500)
    parts = list(tokens._few(texts))
    assert [k for lo, hi in parts for k in range(lo, hi)] == list(range(400)) and len(parts) >= 200


def test_budgets_share_a_scan(spark):
    plan = QUERIES["budget_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 3
