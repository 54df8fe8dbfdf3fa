"""Spelling variants of the words of a corpus: one edit apart, found by the parities of their letters."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import map_batches, materialize, prepare, table, texts

#: Words of fewer code points or occurrences are left out.
SHORTEST, RAREST = 5, 3
#: Of the runs of a document one in so many loses a code point.
DAMAGED = 97
#: Bits of a mask: a-z have one each, the others share the rest. A bit belongs to the band of its number modulo three.
BITS = 60
BANDS = tuple(sum(1 << b for b in range(BITS) if b % 3 == k) for k in range(3))
_BIT = np.array([b for c in range(256) for b in [c - 97 if 97 <= c <= 122 else 26 + c % (BITS - 26)]], np.uint64)


def _words():
    runs = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}").findall  # shorter runs can't become words

    def step(batch: pa.RecordBatch) -> dict:
        total: Counter[str] = Counter()
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs(text.encode().lower().decode())).items():  # bytes.lower() leaves all but A-Z
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < SHORTEST:
                        continue
                total[run] += n
        return {"word": list(total), "n": list(total.values())}

    return step


def corpus_words(docs: DataFrame) -> DataFrame:
    """word and n, the occurrences in all texts, of words of at least ``SHORTEST`` code points and ``RAREST`` occurrences."""
    prepare(docs.sparkSession)
    counted = map_batches(texts(docs), _words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def _parities():
    def step(batch: pa.RecordBatch) -> dict:
        words = batch.column("word").to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        bits = np.uint64(1) << _BIT[letters]
        mask = np.bitwise_xor.reduceat(bits, np.cumsum(size) - size) if len(words) else bits
        shares = np.maximum.reduceat(letters, np.cumsum(size) - size) > 127 if len(words) else np.zeros(0, bool)
        total = np.add.reduceat(bits, np.cumsum(size) - size) if len(words) else bits
        return {"word": batch.column("word"), "n": batch.column("n"), "size": size.astype(np.int32), "mask": mask.astype(np.int64), "total": total.astype(np.int64), "shares": shares}

    return step


def _key(k: int, mask: Column, size: Column) -> Column:
    """What a word shows of itself with band ``k`` left open."""
    return F.struct(F.lit(k).alias("k"), size.alias("size"), mask.bitwiseAND(~BANDS[k] & (1 << BITS) - 1).alias("rest"))


def _without(k: int) -> Column:
    """Keys with band ``k`` open and one set bit of the next band cleared."""
    bits = [b for b in range(BITS) if b % 3 == (k + 1) % 3]
    mask = F.col("mask")
    each = [F.when(mask.bitwiseAND(F.lit(1 << b)) != 0, _key(k, mask.bitwiseXOR(F.lit(1 << b)), F.col("size"))) for b in bits]
    return F.filter(F.array(*each), lambda key: key.isNotNull())


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one inserted, deleted or replaced code point apart, each pair once: word, n, other, other_n.

    A word's mask holds the parity of each letter. An inserted or deleted letter flips one bit, a replaced one two, or none
    where both letters share a bit. Flips within one band leave the other two equal: masks meet by those and the length, or
    a length one apart. Flips in two bands leave one equal, and a mask that has the bit meets the one that lacks it by
    clearing the bit. What meets are masks, each with a length, of which there are far fewer than words; each pair of them
    meets under one key, and only those that differ by one edit's flips bring their words together. Of these the sums of all
    letters' bits have to differ by just the bits that flipped, which leaves few words to verify letter by letter.
    """
    masks = materialize(map_batches(words.select("word", "n"), _parities, "word string, n long, size int, mask long, total long, shares boolean"))
    kinds = masks.groupBy("size", "mask").agg(F.bool_or("shares").alias("shares"))
    mask, size = F.col("mask"), F.col("size")
    held = kinds.select(F.explode(F.array(*[_key(k, mask, size) for k in range(3)])).alias("key"), mask.alias("other_mask"))
    same = [F.struct(F.lit(True).alias("same"), _key(k, mask, size).alias("key")) for k in range(3)]
    longer = [F.struct(F.lit(False).alias("same"), _key(k, mask, size + 1).alias("key")) for k in range(3)]
    cleared = F.transform(F.concat(*[_without(k) for k in range(3)]), lambda key: F.struct(F.lit(False).alias("same"), key.alias("key")))
    sought = kinds.select(F.explode(F.concat(F.array(*same, *longer), cleared)).alias("p"), "mask", "shares", size.alias("own_size"))
    flips = mask.bitwiseXOR(F.col("other_mask"))
    near = (F.bit_count(flips) <= 2) & ((flips != 0) | (F.col("k") == 0)) & (~F.col("same") | (mask < F.col("other_mask")) | ((flips == 0) & F.col("shares")))
    met = sought.select("p.key.*", "p.same", "mask", "shares", "own_size").join(held.select("key.*", "other_mask"), ["k", "size", "rest"]).where(near)
    low = flips.bitwiseAND(-flips)
    swapped = F.col("own_size") == F.col("size")
    by = F.when(swapped, flips - 2 * low).otherwise(flips).alias("by")  # the higher bit less the lower one, or the one bit
    met = met.select("own_size", "mask", F.col("size").alias("other_size"), "other_mask", by)
    of_mask = masks.select(size.alias("own_size"), "mask", "word", "n", "total")
    of_other = masks.select(size.alias("other_size"), mask.alias("other_mask"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("total").alias("other_total"))
    pairs = met.join(of_mask, ["own_size", "mask"]).join(of_other, ["other_size", "other_mask"])
    more = F.col("other_total") - F.col("total")
    fit = (more == F.col("by")) | ((more == -F.col("by")) & (F.col("own_size") == F.col("other_size")))
    one_way = (F.col("mask") != F.col("other_mask")) | (F.col("own_size") != F.col("other_size")) | (F.col("word") < F.col("other"))
    pairs = pairs.where(fit & one_way & (F.levenshtein("word", "other", 1) == 1))
    return pairs.select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, the last form reached: each round doubles the distance, and a form has at least twice its word's n."""
    current = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(current.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        current = step.drop("moved")
        if step.where("moved").isEmpty():
            return current


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all texts.

    A null text has no words; texts of any length are read whole; repeated rows count each for itself, and a null doc_id as
    an empty one; words that tie for a form are taken in code-point order; an empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    words = materialize(corpus_words(docs))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    form = -F.col("best.minus") >= 2 * F.col("n")
    shown = materialize(
        found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.minus")).alias("form_n"))
    )
    roots = _roots(shown.where(F.col("form").isNotNull()))
    return shown.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their variants: word, form, root, n, n_near, form_n (see ``spelling_variants``)."""
    return spelling_variants(table(spark, sf_dir, "documents"))
