import hashlib
import random
import zlib

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidelog.llm.secret_scan import FEATURES, Forest, _parse, candidates, examples, feature_columns, labelled_findings, redact, scan, train
from tidelog.llm.toxicity import FEATURES as TOXIC_FEATURES, Automaton, Scorer, Trie, lookup, toxicity_scores
from tidelog.session import Scratch


def test_automaton_accepts_one_edit():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(2))
        automaton = Automaton(a)
        state = automaton.start
        for letter in b:
            state = automaton.step(state, letter)
        assert (automaton.edits(state) is not None) == (distance(a, b) <= 1), (a, b)


def test_lookup_kinds():
    trie = Trie.of({"stupid": 3.0, "scum": 2.0}, {"lowei": 4.0})
    assert lookup(trie, "stupid") == ("word", 3.0) and lookup(trie, "loweisch") == ("stem", 4.0)
    assert lookup(trie, "stuipd") is None and lookup(trie, "stupd") == ("fuzzy", 3.0) and lookup(trie, "stuppid") == ("fuzzy", 3.0)
    assert lookup(trie, "scums") is None and lookup(trie, "") is None


def test_misspelled_stems_and_signs_at_the_end():
    scorer = Scorer({"stupid": 3.0, "ass": 2.0}, {"idiot": 4.0, "lowe": 1.0})
    assert scorer.match("idiotic") == ("stem", 4.0) and scorer.match("idiiotic") == ("near", 4.0) and scorer.match("idotisch") == ("near", 4.0) and scorer.match("1d1otz") == ("stem", 4.0)
    assert scorer.match("idea") is None and scorer.match("lows") is None
    assert scorer.match("stupid$$$") == ("word", 3.0) and scorer.match("a$$") == ("word", 2.0) and scorer.match("$tupid") == ("word", 3.0) and scorer.match("$$$") is None

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row

    rng = random.Random(2)
    for _ in range(4000):
        word = "".join(rng.choice("idotx") for _ in range(rng.randint(4, 9)))
        found = scorer.match(word)
        near = min(distance("idiot", word)) <= 1
        assert (found is not None and found[1] == 4.0) == near, (word, found)


def test_quoted_and_reported_hits_count_apart():
    scorer = Scorer({"stupid": 3.0}, {})
    at = {f: i for i, f in enumerate(TOXIC_FEATURES)}
    by = lambda text: {f for f, i in at.items() if f != "share" and scorer.features(text)[i] > 0}
    assert by("you are stupid") == {"plain_word"} and by("you are stuppid") == {"plain_fuzzy"}
    assert by('the sign "you are stupid" hung there') == {"quoted"}
    assert by('she said "hello" and you are stupid') == {"plain_word"}
    assert by("she said you are stupid") == {"reported"} and by("dijo que stupid") == {"reported"}
    assert by("") == by(None) == by('" said "') == set()
    assert scorer.features("stupid " * 3)[-1] == 100.0


def test_quotation_is_told_from_abuse(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join("".join(rng.choice("aeiounst") for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = []
    for i in range(600):
        bad = rng.choice(["grumpfel", "blorkish"])
        kind = i % 3
        text = f"{filler(20)} you {bad} {bad} {filler(20)}" if kind == 0 else f'{filler(20)} the word "{bad}" stands {filler(20)} ' if kind == 1 else filler(40)
        rows.append((i, text, int(kind == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity_scores(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and all(p == y for p, y in held)


def test_ties_long_texts_and_clashing_columns(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(7000, rows[0][1] * 2000, 0.5, "y"), (7001, rows[1][1], 0.5, "y")], "doc_id long, text string, score double, features string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[1][0], 1 - rows[1][2])], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == len(rows) + 2 and got[7001].score == got[rows[1][0]].score and got[7000].predicted == 1


def toxic_corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiounst") for _ in range(rng.randint(2, 6)))
    bad = ["grumpfel", "blorkish", "snarvek"]
    rows = []
    for i in range(900):
        words = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_misspellings_and_odd_rows(spark):
    rows = toxic_corpus()
    extra = [(5000, "un tu grumpfl an blorkiish so snarvik in"), (5001, None), (5002, ""), (None, "no hits here"), (0, rows[0][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows) and not by_id[None].held_out
    held = [(by_id[i].predicted, t) for i, _, t in rows if by_id[i].held_out]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert by_id[5000].score > 10 * by_id[5001].score and by_id[5001].score == by_id[5002].score


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.predicted for r in toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0]
    assert toxicity_scores(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def secret_rows():
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    rows, secrets = [], {}
    for i in range(240):
        kind = i % 4
        if kind == 0:
            value = hexes(20)
            text = f"é some words password={value} more words"
        elif kind == 1:
            value = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(15)) + "2"
            text = f"words {value} and then"
        elif kind == 2:
            value = None
            text = f"card {''.join(rng.choice('0123456789') for _ in range(16))} paid"
        else:
            value = None
            text = "an internationalisation2 of words and no secret"
        rows.append((i, text))
        if value:
            secrets[i] = value
    return rows, secrets


def test_finds_secrets_and_not_numbers(spark):
    rows, secrets = secret_rows()
    odd = [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, "x" * 30000 + " \x01 " + "9" * 20)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = scan(docs).collect()
    found = {(r.doc_id, r.value_sha256) for r in got if r.is_secret}
    want = {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in secrets.items()} | {(None, hashlib.sha256(secrets[0].encode()).hexdigest())}
    assert found == want
    texts = dict(rows)
    assert all(hashlib.sha256(texts[r.doc_id][r.start : r.start + r["length"]].encode()).hexdigest() == r.value_sha256 for r in got if r.doc_id in texts)
    masked = {r.doc_id: r for r in redact(docs).collect()}
    assert masked[0].text == "é some words password=[SECRET] more words" and masked[0].start == "clash"
    assert masked[2].text == texts[2] and masked[900].text is None and masked[902].text == odd[-1][1]


def test_no_findings(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert scan(docs).count() == 0 and candidates(docs).count() == 0
    assert {r.text for r in redact(docs).collect()} == {"plain words", None}
    assert scan(docs.limit(0)).count() == 0


def test_finds_short_punctuated_and_letters_only_secrets(spark):
    rows, _ = secret_rows()
    planted = [
        ("login password={} now", "hunter2"), ("pwd: '{}' is set", "S3cret!pass"), ("my passwd = {}, and", "Correct-Horse9!Battery"),
        ("see postgres://user:{}@db.example/x", "p4ssw0rd"), ('{{"api_key": "{}"}}', "QwErTyUiOpAsDfGhJkLz"), ("DB_PASSWORD={};Server=x", "bluemonkey"),
        ("in /etc/app1/config/files/password={} here", "k#9!xq"), ('token="{}" x', "two words; 'quoted"), ("?token={}&user=someone", "zebra!crossing"),
    ]
    want = {1000 + i: v for i, (_, v) in enumerate(planted)}
    texts = {1000 + i: t.format(v) for i, (t, v) in enumerate(planted)}
    texts |= {2000: "the password: ******** hidden", 2001: "password=${PASSWORD} set", 2002: "the secret: internationalisation2 of words", 2003: "if token == another then"}
    common = [(3000 + i, "several frequent ordinary things") for i in range(50)] + [(2004, "the secret: ordinary things")]
    docs = spark.createDataFrame(rows + list(texts.items()) + common, "doc_id long, text string")
    got = [r for r in scan(docs).collect() if r.doc_id >= 1000]
    found = {r.doc_id: r.value_sha256 for r in got if r.is_secret and r.doc_id != 2002}
    assert found == {i: hashlib.sha256(v.encode()).hexdigest() for i, v in want.items()}
    assert all(hashlib.sha256(texts[r.doc_id][r.start : r.start + r["length"]].encode()).hexdigest() == r.value_sha256 for r in got if r.doc_id in texts)
    masked = {r.doc_id: r.text for r in redact(docs).collect()}
    assert all(masked[i] == texts[i].replace(v, "[SECRET]") for i, v in want.items())
    assert masked[2000] == texts[2000] and masked[2004] == "the secret: ordinary things"
    long = "a" * 40_000
    odd = spark.createDataFrame([(1, f"token={long}"), (2, "token=" + "&" * 40_000), (3, 'secret="' + "\\\\" * 20_000), (4, "pwd" * 20_000), (5, "://" + long)], "doc_id long, text string")
    assert {r.doc_id: r["length"] for r in candidates(odd).select("doc_id", F.length("value").alias("length")).collect()}[1] == 40_000


def test_marks_of_the_scanner_stay_in_the_text(spark):
    rows = [(1, "a\x01b password=Xk9mmQ2zTT end\ufdd0"), (2, "\ufdd1\x01 nothing \ufdd0"), (3, "pwd: 'q\x01w9z#Qt' é\x01")]
    base, _ = secret_rows()
    docs = spark.createDataFrame(base + [(1000 + i, t) for i, t in rows], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in redact(docs).collect()}
    assert [masked[1000 + i] for i, _ in rows] == ["a\x01b password=[SECRET] end\ufdd0", rows[1][1], "pwd: '[SECRET]' é\x01"]
    found = {r.doc_id: r for r in scan(docs).collect() if r.is_secret and r.doc_id > 1000}
    assert found[1003].value_sha256 == hashlib.sha256(b"q\x01w9z#Qt").hexdigest() and found[1001].start == 13


def test_unfolded_trees_vote_as_the_fitted_forest_and_unseen_kinds_are_found(spark):
    rows, _ = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch, words = Scratch(spark), ["internationalisation", "between", "several", "ordinary", "thousand"]
    findings = scratch.cut(labelled_findings(candidates(docs), words))
    recalls = {}
    for kind in ("hex", "letters", "punctuated", "word and digits", "phrase"):
        forest = train(findings, words, scratch, leave_out=(kind,))
        held = [r for r in examples(words, seed=77) if r[4] == kind or r[3] == 0.0]
        table = spark.createDataFrame(held, "value string, before string, after string, label double, kind string")
        votes = table.withColumn("v", forest.votes(F.col("value"), F.col("before"), F.col("after"))).collect()
        recalls[kind] = sum(r.v >= 0.5 for r in votes if r.kind == kind) / sum(r.kind == kind for r in votes)
        assert sum(r.v >= 0.5 for r in votes if r.label == 0.0) <= 0.1 * sum(r.label == 0.0 for r in votes)
    assert min(recalls.values()) > 0.8, recalls
    # The expressions against Spark's own predictions.
    named = [c.alias(n) for c, n in zip(feature_columns(F.col("value"), F.col("before"), F.col("after"), words), FEATURES, strict=True)]
    rows = spark.createDataFrame(examples(words, seed=5), "value string, before string, after string, label double, kind string").select("*", *named)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol="label", numTrees=7, maxDepth=4, featureSubsetStrategy="sqrt", seed=3).fit(vectors)
    grown = [_parse([x for x in t.toDebugString.split("\n")[1:] if x.strip()]) for t in model.trees]
    forest = Forest(words, grown)
    both = model.transform(vectors).select("probability", forest.votes(F.col("value"), F.col("before"), F.col("after")).alias("v"), *[vector_to_array("features").alias("f")])
    trees = [t.predict for t in model.trees]
    for r in both.collect():
        assert abs(r.v - sum(p(Vectors.dense(r.f)) for p in trees) / len(trees)) < 1e-9
