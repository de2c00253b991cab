"""Secret scanning with a random forest that removes false positives.

Candidates are long tokens with a digit, values of any characters assigned to a name for secrets, and passwords in the user part
of an address.  Each is described by its length, its character classes and the transitions between
them, how much of it common words of the corpus cover, whether it stands in a path, and the words around it.  A random forest
trained on labelled findings, and on generated ones of the last two forms, votes on it.  The trees are unfolded into nested conditional expressions, so scanning and
redacting are one projection per text: no join, no shuffle, no Python.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

MARK = "\x01"
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])([A-Za-z0-9+/_\-]{16,}+={0,2})"
SHORTEST = 16
# Marks of values that are assigned or in an address, until the long tokens around them are marked too (Unicode noncharacters).
OPEN, CLOSE = "\ufdd0", "\ufdd1"
# Labelled findings used to train, half of each class where there are enough.
SAMPLE = 20_000
TREES = 24
DEPTH = 6
DICTIONARY = 400
NEAR = 40
# Words and formats that tell what kind of value follows.
KEY_WORDS = r"(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential)"
ID_WORDS = r"(?i)(sha1|sha256|md5|checksum|commit|uuid|etag|isbn|iban|card|phone|tel|order|invoice|serial)"
KNOWN_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35})$"
ASSIGNED = r"(?i)(password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?$"

# A name for secrets, its separator and an authentication scheme, then a quoted value or one up to the next blank, of 6 characters or
# more.  Without quotes it ends before the next field of a list and leaves out the marks that end a sentence; there the count of
# marks in the value bounds the depth of the matcher.
SEPARATOR = r"[A-Za-z0-9_\-]{0,40}+[\"']?\s{0,2}(?::?=|:)\s{0,2}(?:(?i:bearer|basic)\s{1,2})?[\"']?"
VALUE = (
    r"(?<=\")(?=[^\"\r\n]{6})(?:[^\"\\\r\n]++|\\.)++(?=\")|(?<=')(?=[^'\r\n]{6})(?:[^'\\\r\n]++|\\.)++(?=')"
    r"|(?=[^\s\"'=]\S{5})[^\s&;,<]*(?:(?!</|[&;,][\w.\-]+\s?=)[&;,<][^\s&;,<]*){0,200}(?<![,;.\"'])"
)
USER_PART = r"://[^\s:/@\"'<>]*+:"
NAMED = rf"({KEY_WORDS.replace('(?i)(', '(?i:')}{SEPARATOR})({VALUE})|({USER_PART})([^\s/\"'<>]+)(?=@[A-Za-z0-9\[])"
# What stands in place of a value.
PLACEHOLDER = r"(?i)^([*x.\-_]+|<.*>|\$?\{.*\}|\$\w+|%\w+%|\[.*\]|null|none|true|false|undefined|required|optional|changeme|your.*)$"
# Generated findings that join the labelled ones: a corpus may hold few of these forms.  They are a fifth of each class at least.
PER_KIND = 24
PUNCTUATION = "!#@.-_$%&*+?^~"
FLAGS = ("null", "none", "true", "false", "undefined", "required", "optional", "changeme", "default", "hidden")
CONTEXTS = (("password=", " "), ("pwd: '", "'"), ('"token": "', '"'), ("api_key = ", "\n"), ("the secret: ", " "))

FEATURES = (
    "length", "digits", "upper", "lower", "hex", "transitions", "distinct", "dictionary",
    "path", "key_word", "id_word", "assigned", "quoted", "base64",
)


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent plain words of 4 to 10 letters over all texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z]+"))).alias("word"))
    # A word of one text only is not frequent; it may be a secret.
    counts = words.filter(F.length("word").between(4, 10)).groupBy("word").count().filter("count > 1")
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def feature_columns(value: Column, before: Column, after: Column, words: list[str]) -> list[Column]:
    """One numeric column per entry of ``FEATURES``."""
    length = F.length(value)

    def share(pattern: str) -> Column:
        return (length - F.length(F.regexp_replace(value, pattern, ""))) / length

    runs = value
    for pattern, sign in (("[0-9]+", "0"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        runs = F.regexp_replace(runs, pattern, sign)
    known = F.regexp_replace(F.lower(value), "(" + "|".join(words) + ")", "") if words else value
    near = F.right(before, F.lit(NEAR))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        length.cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        flag(value.rlike("^[0-9a-fA-F]+$")),
        F.length(runs) / length,
        F.size(F.array_distinct(F.split(value, ""))) / length,
        1.0 - F.length(known) / length,
        flag(before.rlike(r"(://\S*|[/\\.])$") | value.contains("/")),
        flag(near.rlike(KEY_WORDS)),
        flag(near.rlike(ID_WORDS)),
        flag(before.rlike(r"[=:]\s{0,2}[\"']?$")),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        flag(value.rlike("[+/=]")),
    ]


# ---------------------------------------------------------------- candidates


def with_pieces(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``_pieces``: the text cut at its candidates, which have the odd places (counting from 0).

    A text that holds one of the marks itself is searched with blanks in their place, and its pieces are cut from what it was.
    """
    own = F.coalesce(F.col(text_col), F.lit(""))
    named = F.regexp_replace(F.translate(own, MARK + OPEN + CLOSE, "   "), NAMED, f"$1$3{OPEN}$2$4{CLOSE}")
    marked = F.regexp_replace(named, f"{OPEN}([^{CLOSE}]*+){CLOSE}|{CANDIDATE}", f"{MARK}$1$2{MARK}")
    cut = F.split(marked, MARK, -1)
    restored = F.transform(F.arrays_zip(_starts(cut).alias("at"), F.transform(cut, lambda p: F.length(p)).alias("n")), lambda p: own.substr(p["at"].cast("int") + 1, p["n"]))
    return docs.withColumn("_pieces", F.when(own.rlike(f"[{MARK}{OPEN}{CLOSE}]"), F.slice(restored, 1, F.size(cut))).otherwise(cut))


def _starts(pieces: Column) -> Column:
    """Places of all pieces, and of the end, in one pass over them."""
    return F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))


def _around(at: Column) -> tuple[Column, Column]:
    """The text before and after the piece ``at``; another candidate may be part of it."""
    before = F.concat(F.coalesce(F.get("_pieces", at - 2), F.lit("")), F.get("_pieces", at - 1))
    return F.right(before, F.lit(80)), F.left(F.get("_pieces", at + 1), F.lit(40))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, value, before, after)``, a row per candidate; ``start`` counts code points from 0."""
    cut = with_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "_pieces")
    odd = F.when(F.size("_pieces") > 1, F.sequence(F.lit(1), F.size("_pieces") - 2, F.lit(2)))
    at = F.explode(odd).alias("at")
    rows = cut.withColumn("_starts", _starts(F.col("_pieces"))).select("doc_id", "_pieces", "_starts", at)
    before, after = _around(F.col("at"))
    return rows.select(
        "doc_id",
        F.get("_starts", F.col("at")).alias("start"),
        F.get("_pieces", F.col("at")).alias("value"),
        before.alias("before"),
        after.alias("after"),
    )


# ---------------------------------------------------------------- forest


@dataclass(frozen=True)
class Forest:
    words: list[str]
    trees: list[Tree | float]

    def votes(self, value: Column, before: Column, after: Column) -> Column:
        """Share of trees that call the candidate a secret."""
        features = F.array(*[c.cast("double") for c in feature_columns(value, before, after, self.words)])

        def of(f: Column) -> Column:
            total = F.lit(0.0)
            for tree in self.trees:
                total = total + _unfold(tree, f)
            return total / F.lit(float(max(1, len(self.trees))))

        # The features are bound once to the variable of a one-element transform; every node reads that variable.
        return F.get(F.transform(F.array(features), of), F.lit(0))


@dataclass(frozen=True)
class Tree:
    feature: int
    threshold: float
    low: Tree | float
    high: Tree | float


def _unfold(tree: Tree | float, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(F.get(f, F.lit(tree.feature)) <= F.lit(tree.threshold), _unfold(tree.low, f)).otherwise(_unfold(tree.high, f))


def _parse(lines: list[str]) -> Tree | float:
    """A tree from the printed form of a fitted model: ``If (feature i <= t)``, its branch, ``Else``, the other; ``Predict: y``."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return float(head.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", head).groups()
    low = _parse(lines)
    lines.pop(0)
    return Tree(int(feature), float(threshold), low, _parse(lines))


def labelled_findings(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Add ``label`` to candidates that a format decides, and drop the others.

    1: a published key format, a value assigned to a name for secrets, or a password in an address.  0: a placeholder or one of the
    frequent ``words`` in place of a value; elsewhere digits only, or letters with at most two digits.
    """
    value, before = F.col("value"), F.col("before")
    named = before.rlike(f"({KEY_WORDS}{SEPARATOR}|{USER_PART})$")
    label = (
        F.when(named & (value.rlike(PLACEHOLDER) | F.lower(value).isin(words or [])), 0)
        .when(value.rlike(KNOWN_FORMATS) | before.rlike(f"{ASSIGNED}|{USER_PART}$"), 1)
        .when(named, F.lit(None).cast("int"))
        .when(value.rlike("^[0-9]+$") | (F.length(F.regexp_replace(value, "[^0-9]", "")) <= 2), 0)
    )
    return found.withColumn("label", label).filter(F.col("label").isNotNull())


def _letters(rng: random.Random, low: int, high: int, signs: str) -> str:
    return "".join(rng.choice(signs) for _ in range(rng.randint(low, high)))


def _word(rng: random.Random) -> str:
    """A pronounceable word that is in no dictionary."""
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) + rng.choice(["", "n", "r", "x"])


# What secrets look like, kind by kind, and what stands in their place.
SECRET_KINDS = {
    "hex": lambda rng, words: _letters(rng, 8, 40, "0123456789abcdef"),
    "base64": lambda rng, words: _letters(rng, 12, 44, string.ascii_letters + string.digits + "+/"),
    "letters": lambda rng, words: _letters(rng, 8, 30, string.ascii_letters),
    "mixed": lambda rng, words: _letters(rng, 6, 16, string.ascii_letters + string.digits),
    "punctuated": lambda rng, words: _letters(rng, 6, 18, string.ascii_letters + string.digits + PUNCTUATION),
    "word": lambda rng, words: (_word(rng) + _word(rng) if rng.random() < 0.5 else _word(rng))[:14].ljust(6, "e"),
    "word and digits": lambda rng, words: rng.choice([_word(rng), _word(rng).title()]) + _letters(rng, 2, 4, string.digits),
    "phrase": lambda rng, words: rng.choice("-._ ").join(rng.choice([w, w.title()]) for w in (_word(rng), _word(rng), _word(rng))) + _letters(rng, 0, 2, string.digits + "!"),
}
OTHER_KINDS = {
    "starred": lambda rng, words: rng.choice("*x.-_") * rng.randint(6, 14),
    "bracketed": lambda rng, words: rng.choice(["<{}>", "${{{}}}", "{{{{{}}}}}", "%{}%", "[{}]", "${}"]).format(rng.choice(["password", "PASSWORD", "token", "your_key", _word(rng)])),
    "flag": lambda rng, words: rng.choice([*FLAGS, "your-" + rng.choice(["token", "password", "key"])]),
    "plain": lambda rng, words: rng.choice([w for w in words if len(w) >= 6] or ["password"]),
}

# The same for long tokens that no name announces.
BARE_SECRETS = {
    "published format": lambda rng, words: rng.choice(["AKIA" + _letters(rng, 16, 16, string.ascii_uppercase + string.digits), "ghp_" + _letters(rng, 36, 40, string.ascii_letters + string.digits), "sk_live_" + _letters(rng, 16, 30, string.ascii_letters + string.digits)]),
}
BARE_OTHERS = {
    "number": lambda rng, words: _letters(rng, 16, 22, string.digits),
    "long word": lambda rng, words: "".join(_word(rng) for _ in range(4)).ljust(16, "e") + _letters(rng, 1, 2, string.digits),
    "path": lambda rng, words: rng.choice("/-_").join(_word(rng) for _ in range(5)) + "/" + _letters(rng, 1, 2, string.digits),
}
BARE_CONTEXTS = (("some words ", " and more"), ("card ", " paid"), ("see ", ", which"), ("at (", ") there"), ("", ""))


def examples(words: list[str], seed: int = 11, per_kind: int = PER_KIND, leave_out: tuple[str, ...] = ()) -> list[tuple[str, str, str, float, str]]:
    """``(value, before, after, label, kind)``: generated secrets and what is none, announced by a name, in addresses, and in plain text."""
    rows = []
    for label, kinds, contexts in ((1.0, SECRET_KINDS, CONTEXTS), (0.0, OTHER_KINDS, CONTEXTS), (1.0, BARE_SECRETS, BARE_CONTEXTS), (0.0, BARE_OTHERS, BARE_CONTEXTS)):
        for kind, make in kinds.items():
            rng = random.Random(f"{seed} {kind}")
            for _ in range(per_kind if kind not in leave_out else 0):
                value = make(rng, words)
                rows += [(value, before, after, label, kind) for before, after in contexts]
                if kind in SECRET_KINDS and " " not in value and "/" not in value:
                    rows.append((value, "postgres://admin:", "@db", label, kind))
    return rows


def train(findings: DataFrame, words: list[str], scratch: Scratch, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, leave_out: tuple[str, ...] = ()) -> Forest:
    """A forest from ``findings (value, before, after, label)``, at most ``sample`` of them, chosen by a hash of their content, and
    generated ones of all kinds but ``leave_out``.

    With findings of one class only, or none, every candidate gets that class (none: secret, so nothing is hidden).
    """
    order = F.xxhash64("value", "before", "after")
    named = [c.alias(n) for c, n in zip(feature_columns(F.col("value"), F.col("before"), F.col("after"), words), FEATURES, strict=True)]
    picked = [findings.filter(F.col("label") == k).orderBy(order).limit(sample // 2) for k in (0, 1)]
    rows = scratch.cut(picked[0].unionByName(picked[1]).select(F.col("label").cast("double").alias("label"), *named), "findings")
    classes = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(classes) < 2:
        return Forest(words, [classes.pop() if classes else 1.0])
    made = examples(words, leave_out=leave_out)
    fixed = findings.sparkSession.createDataFrame(made, "value string, before string, after string, label double, kind string")
    for k, n in ((r["label"], r["count"]) for r in rows.groupBy("label").count().collect()):
        same = fixed.filter(F.col("label") == k).select("label", *named)
        times = max(1, n // (4 * same.count()))
        rows = rows.unionByName(same.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_n"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=23).fit(vectors)
    grown = []
    for tree in model.trees:
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        grown.append(_parse(lines))
    return Forest(words, grown)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> Forest:
    """Train on given findings, or on candidates of ``docs`` that ``labelled_findings`` can label."""
    scratch = Scratch(docs.sparkSession)
    words = dictionary(docs, text_col)
    if findings is None:
        findings = scratch.cut(labelled_findings(candidates(docs, id_col, text_col), words), "labelled")
    return train(findings, words, scratch)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, forest: Forest | None = None) -> DataFrame:
    """``(doc_id, start, length, value_sha256, score, is_secret)``, a row per candidate of every whole text.

    ``start`` and ``length`` count code points; the value itself is not returned.  ``score`` is the share of trees for a
    secret, ``is_secret`` at least half.  Null, empty and candidate-free texts give no rows; repeated rows give repeated rows;
    a null id is carried; other columns are ignored; an empty table gives no rows.
    """
    forest = forest or fit(docs, id_col, text_col, findings)
    found = candidates(docs, id_col, text_col)
    score = forest.votes(F.col("value"), F.col("before"), F.col("after"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), score.alias("score")
    ).withColumn("is_secret", F.col("score") >= 0.5)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", forest: Forest | None = None) -> DataFrame:
    """Rows of ``docs`` with every secret of ``text_col`` replaced by ``mask``; texts without a secret stay as they are."""
    forest = forest or fit(docs, id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    cut = with_pieces(docs.select(whole, F.col(f"`{text_col}`").alias("text")), "text")

    def masked(piece: Column, at: Column) -> Column:
        before, after = _around(at)
        return F.when((at % 2 == 1) & (forest.votes(piece, before, after) >= 0.5), F.lit(mask)).otherwise(piece)

    cut = cut.withColumn("_masked", F.when(F.size("_pieces") > 1, F.transform("_pieces", masked)))
    text = F.when(F.col("_masked").isNull() | (F.col("_masked") == F.col("_pieces")), F.col("text")).otherwise(F.array_join("_masked", ""))
    out = cut.select("row", text.alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
