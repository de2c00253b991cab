import random
import re
from collections import Counter

from tidelog.llm.quality_rules import BASE, keep_good, quality_verdicts, with_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(threes)
    covered = {i + j for i, t in enumerate(threes) if often[t] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts(seed, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 120))]
        bad = i % 3 == 0
        if bad:
            words = [w + "###" if rng.random() < 0.5 else w for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        out.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)), int(not bad)))
    return out


ODD = [None, "", " \n\t", "one", "a b c a b c a b c", "x y\nx y\n\nx y\r\n", "a\x0bb\x0cc\x85d", "é ß 🙂 🙂 🙂 🙂", "w " * 4000, "# | <a> && 100%"]


def test_statistics_equal_counting(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(random.Random(i).choice("ab") for _ in range(40))) for i in range(20)]
    got = with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = brute(r.text)
        assert tuple(r[c] for c in BASE) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_are_learned_and_judge_held_out_rows(spark):
    rows = texts(2, 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] // 6 % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_verdicts(docs, labels).collect()}
    right = [got[i].kept == bool(q) for i, _, q in rows if i // 6 % 2 == 0 and not got[i].base_failed]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)
    kept = {r.doc_id for r in keep_good(docs.withColumn("row", docs.doc_id), labels).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_without_labels_the_base_rules_decide(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "short"), (None, None), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((str(r.doc_id), r.kept) for r in quality_verdicts(docs, labels).collect()) == [("1", True), ("2", False), ("2", False), ("None", False)]
    assert quality_verdicts(docs.limit(0), labels).count() == 0
    assert keep_good(docs.limit(0), labels).columns == ["doc_id", "text"]
