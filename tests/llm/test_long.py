"""Texts of a megabyte, very many matches in one text, and columns of every kind of name."""

import random
import time

import pytest
from pyspark.sql import functions as F

from triplicate.llm import bpe, packing, pii, secrets, simhash, spelling, substrings, token_counts, toxicity

MB = 1_000_000


def long_texts():
    rng = random.Random(2)
    words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(MB // 6))
    return {
        "path": "see " + "ab/" * (MB // 3) + "x1 end", "words": words, "one": "x" * MB, "digits": "1 " * (MB // 2), "spaces": " " * MB, "letters": "Ab1/" * (MB // 4),
        "hex": ("0123456789abcdef" * 2 + " ") * (MB // 33), "mails": "joe@mail.example.com " * (MB // 21), "spelled": "one two dot " * (MB // 12),
    }


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(long_texts().values())], "doc_id long, text string").cache()


OPERATORS = {
    "pii": pii.find_pii, "secrets": secrets.find_secrets, "bpe": bpe.encode_decode,
    "packing": packing.pack, "substrings": substrings.count_kept, "spelling": spelling.corpus_words, "token_counts": token_counts.count_tokens, "redact": pii.redact_pii,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_texts_of_a_megabyte(docs, name):
    began = time.time()
    assert OPERATORS[name](docs).count() >= (0 if name == "spelling" else docs.count())
    assert time.time() - began < 120


def test_long_paths_are_allowed_and_other_long_runs_are_not(spark):
    rows = [(0, "see " + "ab/" * 300_000 + "x1 end"), (1, "see " + "ab/" * 4 + "/cd/ef/gh/ij/x1k end"), (2, "key Zk3x9Qw7Lp2Vn8Rt5Yb1Mh6 end")]
    found = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == "" and found[2] == "entropy:4:27"


def test_candidates_outside_of_patterns(spark):
    rng = random.Random(4)
    mixed = lambda: "".join(rng.choice("abcdefGHIJKLmnopQRSTUV0123456789") for _ in range(30))
    words = [rng.choice([mixed(), "password=" + mixed(), "0123456789abcdef" * 2 + "77aa", "AKIA" + "Q7" * 12, "plain", mixed() + "/" + mixed()]) for _ in range(3000)]
    text = " ".join(words)
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    base = [(a, b) for k, a, b in spans if k != "entropy"]
    added = [(a, b) for k, a, b in spans if k == "entropy"]
    assert added and base and not any(a <= x and y <= b for x, y in added for a, b in base)


@pytest.mark.parametrize("unit", ["0123456789abcdef0123456789abcdef0a7b ", "joe at mail dot example dot com; "])
def test_many_matches_take_time_in_proportion(spark, unit):
    operator = secrets.find_secrets if unit[0] == "0" else pii.find_pii
    seconds = []
    for n in (5_000, 5_000, 20_000):
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        began = time.time()
        assert len(operator(df).collect()[0].spans) > n
        seconds.append(time.time() - began)
    assert seconds[2] < 10 * max(seconds[1], 0.5)


def test_cover_holds_what_any_span_holds():
    rng = random.Random(9)
    for _ in range(200):
        spans = [("ip", a := rng.randint(0, 30), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 6))]
        start = rng.randint(0, 30)
        end = start + rng.randint(1, 6)
        assert pii._Cover(spans).holds(start, end) == any(a <= start and end <= b for _, a, b in spans)


def test_stages_with_columns_of_any_name(spark):
    odd = spark.range(40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") != 3, F.concat(F.lit("mail joe@mail.example.com words here number "), F.col("id") % 5)).alias("text"),
        F.struct(F.lit(1).alias("a-b"), F.lit("x").alias("c d")).alias("s t"), F.lit(True).alias("we`ird"), F.array(F.lit(1.5)).alias("toxic_score"), F.lit(1).cast("decimal(12,3)").alias("x.y"), F.current_date().alias("lang"),
    )
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    kept = {c: t for c, t in odd.dtypes}
    model = toxicity.train(odd, labels)
    for out in (pii.redact_pii(odd), toxicity.drop_toxic(odd, model), substrings.remove_duplicates(odd), simhash.drop_near_duplicates(odd)):
        assert dict(out.dtypes) == kept
        out.collect()
    assert pii.redact_pii(odd).where("text is null").count() == 1
    assert sorted(map(str, pii.redact_pii(odd).drop("text").collect())) == sorted(map(str, odd.drop("text").collect()))
