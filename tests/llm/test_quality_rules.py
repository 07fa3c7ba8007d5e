import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q

BLANKS = " \t\n\x0b\x0c\r"


def counts(text):
    """Brute force of the five counts."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    chance = random.Random(4)
    out = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h i", "a " * 9, "w " * 40, "x\x0bY\x1cz \xa0 ñ😀 <b>#", "same\nsame\n\n \n \nsame\r", "a\r\nb\na\r\n"]
    for _ in range(300):
        n = chance.randrange(1, 120)
        own = [chance.choice("abcdefgh") * chance.randrange(1, 3) for _ in range(n)]
        at = chance.randrange(n)
        part = own[at : at + chance.randrange(6, 14)]
        out.append("".join(w + chance.choice([" ", "  ", "\n", "\t"]) for w in own + ["mid"] * chance.randrange(3) + part + part[:4]))
    out.append(" ".join(f"w{k % 5000}" for k in range(12_000)))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:6]) for r in q.with_statistics(frame).select("_id", *q.COUNTS).collect()}
    assert got == {k: counts(t) for k, t in rows}


def labelled(spark, n=600, seed=1):
    chance = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [chance.choice("abcdefghijklmnop") + chance.choice("aeiou") * chance.randrange(1, 6) + str(chance.randrange(40)) for _ in range(chance.randrange(20, 90))]
        kind = chance.randrange(4)
        if kind == 0:
            words = [w + chance.choice(["###", "%%%", "$$"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(kind > 1)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_learn_what_labels_say(spark):
    docs, labels = labelled(spark)
    rules = q.learn(q.with_statistics(docs), labels)
    assert 1 <= len(rules.rules) <= 6, str(rules)
    assert {c.measure for r in rules.rules for c in r} <= set(q.measures()) and "reject if" in str(rules)
    fresh, truth = labelled(spark, seed=2)
    out = q.apply_rules(fresh, truth.limit(0)).select("doc_id")
    assert out.count() == 600  # without labels nothing is learned, and all rows come back
    verdict = q.with_statistics(fresh).select("_id", rules.first_rule().isNull().cast("int").alias("kept")).join(truth, F.col("_id") == F.col("doc_id"))
    assert verdict.where("kept = quality").count() >= 590


def test_order_is_that_of_the_list(spark):
    rules = q.DecisionList([(q.Condition("n_words", 10.0, True), q.Condition("symbols_per_word", 1.0, True)), (q.Condition("n_words", 30.0, True),)])
    rows = spark.createDataFrame([(1, "#$ " * 40), (2, "a " * 40), (3, "#$ " * 12), (4, "a b")], "doc_id long, text string")
    got = dict(map(tuple, q.with_statistics(rows).select("_id", rules.first_rule()).collect()))
    assert got == {1: "n_words >= 10 and symbols_per_word >= 1", 2: "n_words >= 30", 3: "n_words >= 10 and symbols_per_word >= 1", 4: None}


@pytest.mark.parametrize("p,n,k", [([9, 8, 3], [6, 1, 0], 3), ([9, 8, 8], [6, 1, 1], 2), ([0, 0], [0, 0], 1)])
def test_pruning_takes_the_best_beginning(p, n, k):
    rule = [q.Condition("n_words", float(x), True) for x in range(len(p))]
    assert len(q._pruned(rule, list(zip(p, n, strict=True)))[0]) == k


def test_odd_tables(spark):
    docs, labels = labelled(spark, 200)
    odd = docs.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("_id"), F.lit(2).alias("kept"), F.lit(0).alias("_words"))
    odd = odd.unionByName(odd.limit(3)).unionByName(spark.createDataFrame([(None, "a " * 30), (7, None), (None, None)], "doc_id long, text string"), allowMissingColumns=True)
    messy = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")).withColumn("text", F.lit("t"))
    out = q.apply_rules(odd, messy)
    assert out.columns == ["doc_id", *q.COUNTS, "base_failed", "kept", "rule"] and out.count() == 206
    assert out.where("base_failed AND kept").count() == 0 and out.where("rule IS NULL AND NOT kept").count() == 0
    kept = q.kept_documents(odd, messy)
    assert kept.columns == odd.columns and kept.count() == out.where("kept").count()
    assert q.apply_rules(docs.limit(0), labels).count() == 0 and q.apply_rules(docs, labels.limit(0)).where("kept").count() == 200
    one_kind = q.apply_rules(docs, labels.withColumn("quality", F.lit(0)))
    assert one_kind.where("kept").count() == 200  # with one kind of label nothing can be learned
